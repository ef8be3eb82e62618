"""DataFrame operators: line parsing, the five incident queries, case files, grading."""
