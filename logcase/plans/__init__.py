"""Plans built on the operators: sizing guards, the log view of the driver's
``events`` table, line builders for round trips, and the registered queries."""
