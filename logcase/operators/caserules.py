"""The case-file protocol as a table of rules, and the walk that holds documents against it (V1/V2).

A document is walked level by level. A step turns the objects of one level into an array of entries (level, place, key,
type name, value) and looks each entry up in the rule table, which says what kind of value may stand there, whether it
may be null, what it may be out of, and whether its object or its list items are the next level. Every step is a
projection of its own behind a one-row generator, so Catalyst neither merges the steps nor repeats them in a filter on
their result. The plan has the same size whatever the number of rules; nothing is shuffled.

Most documents need no walk. The rule table also gives patterns of the type names (``schema_of_variant``) of a document and
of its list items that have the plain form of every rule: no key missing or unknown, nothing null that may not be, numbers
as numbers, and so on. What the walk could still find in a document of that form is the value faults of single fields;
those are read from their places. Every other document is walked, with the same codes in the same order.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The case-file protocol (version, enums, limits, keys).
CASE_VERSION = "0.1"
TOOLS = ("schema", "top_errors", "search", "around", "trace", "submit_incident_report", "llm_query")
TERMINATION_REASONS = ("submitted", "max_iterations", "max_llm_calls", "max_wall_clock", "aborted", "error")
MAX_CONTEXT_LINES = 3
DEFAULT_TEMPERATURE = 0.2

# Each object level: its fields (kind, and flags: "!" required, "?" may be null), and whether other keys may stand there.
# Kinds: string, integer, number, boolean, time, object, list, strings (a list of strings), text_or_object.
LEVELS = {
    "case": ({"version": "string", "question": "string!", "model": "object!", "logs_manifest": "object!", "trajectory": "list!",
              "report": "object?", "termination_reason": "string!", "usage": "object", "ground_truth": "object?"}, False),
    "model": ({"provider": "string!", "name": "string!", "temperature": "number"}, False),
    "logs_manifest": ({"files": "list!", "time_window": "object!", "total_rows": "integer!"}, False),
    "file": ({"path": "string!", "bytes": "integer!", "rows": "integer!", "sha256": "string!"}, False),
    "time_window": ({"start": "time!", "end": "time!"}, False),
    "step": ({"step": "integer!", "tool": "string!", "args": "object", "stdout_excerpt": "string", "stderr_excerpt": "string",
              "elapsed_ms": "integer", "report_delta": "object?"}, False),
    "report": ({"root_cause": "string!", "blast_radius": "text_or_object!", "evidence": "list!", "remediation": "string!",
                "confidence": "number!", "confidence_rationale": "string!", "unknowns": "strings"}, False),
    "blast_radius": ({"duration_minutes": "integer?", "window_start": "time?", "window_end": "time?"}, True),
    "evidence": ({"event_id": "string?", "file": "string!", "line": "integer!", "ts": "time!", "service": "string!",
                  "level": "string!", "text_redacted": "string!", "context_before": "strings", "context_after": "strings",
                  "why": "string!", "is_key": "boolean"}, False),
    "usage": ({"llm_calls": "integer", "tool_calls": "integer", "wall_clock_s": "number", "input_tokens": "integer",
               "output_tokens": "integer"}, False),
    "ground_truth": ({"incident_id": "string?", "root_cause": "string!", "evidence_event_ids": "strings",
                      "blast_radius": "text_or_object?", "remediation": "text_or_object?", "distractors": "list"}, True),
    "distractor": ({}, True),
}

# Objects and list items that are levels of their own, and what else a value must keep to.
OBJECTS = {"case.model": "model", "case.logs_manifest": "logs_manifest", "case.report": "report", "case.usage": "usage",
           "case.ground_truth": "ground_truth", "logs_manifest.time_window": "time_window", "report.blast_radius": "blast_radius"}
ITEMS = {"case.trajectory": "step", "report.evidence": "evidence", "logs_manifest.files": "file", "ground_truth.distractors": "distractor"}
ALLOWED = {"case.version": (CASE_VERSION,), "case.termination_reason": TERMINATION_REASONS, "step.tool": TOOLS}
RANGES = {"report.confidence": (0.0, 1.0)}
MOST_ITEMS = {"evidence.context_before": MAX_CONTEXT_LINES, "evidence.context_after": MAX_CONTEXT_LINES}
#: Levels below one another: the case, its parts, and their parts.
DEPTH = 3


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, behind a one-row generator."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def _none() -> Column:
    return F.array().cast("array<string>")


_RULE = "struct<kind:string,nullable:boolean,object:string,items:string,allowed:array<string>,low:double,high:double,most:int>"
_LEVEL = "struct<required:array<string>,known:array<string>,open:boolean>"


def _rule_table() -> tuple[Column, Column]:
    """Constant maps by place of a key (``level.key``), and by level."""
    rules, levels = {}, {}
    for level, (fields, open_) in LEVELS.items():
        levels[level] = {"required": [k for k, spec in fields.items() if spec.endswith("!")], "known": list(fields), "open": open_}
        for key, spec in fields.items():
            at = f"{level}.{key}"
            low, high = RANGES.get(at, (None, None))
            rules[at] = {"kind": spec.rstrip("!?"), "nullable": spec.endswith("?"), "object": OBJECTS.get(at), "items": ITEMS.get(at),
                         "allowed": ALLOWED.get(at), "low": low, "high": high, "most": MOST_ITEMS.get(at)}
    constant = lambda table, kind: F.from_json(F.lit(json.dumps(table)), f"map<string,{kind}>")
    return constant(rules, _RULE), constant(levels, _LEVEL)


def _time_like(text: Column) -> Column:
    return text.rlike("^[-+]?[0-9]") & (text.try_cast("timestamp").isNotNull() | text.try_cast("double").isNotNull())


# Type names in the plain form of each kind. Names of odd keys stand in back quotes.
_ANY = r"(?:[^<>`]++|`[^`]*+`)*+"
for _ in range(6):
    _ANY = rf"(?:[^<>`]++|`[^`]*+`|<{_ANY}>)*+"
_PLAIN = {"string": "STRING", "integer": "BIGINT", "number": r"(?:BIGINT|DOUBLE|DECIMAL\([0-9]+,[0-9]+\))", "boolean": "BOOLEAN",
          "time": "STRING", "object": f"OBJECT<{_ANY}>", "text_or_object": "STRING", "list": f"ARRAY<{_ANY}>", "strings": "ARRAY<(?:STRING|VOID)>"}


def _plain_form(level: str) -> str:
    """A pattern of the type name of an object of this level that breaks no rule but, perhaps, by a value."""
    fields = ""
    for key, spec in sorted(LEVELS[level][0].items()):
        below, kind = OBJECTS.get(f"{level}.{key}"), spec.rstrip("!?")
        form = _plain_form(below) if kind == "object" and below else _PLAIN[kind]
        if below and LEVELS[below][1]:  # other keys may stand there: only what is no object is plain
            form = "STRING" if kind == "text_or_object" else "VOID"
        form = f"(?:{form}|VOID)" if spec.endswith("?") else form
        fields += rf"(?:(?:(?<=<)|, ){key}: {form})" + ("" if spec.endswith("!") else "?")
    return f"OBJECT<{fields}>"


def _has_form(v: Column, level: str) -> Column:
    return F.schema_of_variant(v).rlike(rf"\A{_plain_form(level)}\z")


def _plain(doc: Column) -> Column:
    """The document is of the plain form, all its items too, and its times and lists of texts can be read."""
    items = lambda at: F.try_variant_get(doc, at, "array<variant>")
    time = lambda v, at: _time_like(F.trim(F.try_variant_get(v, at, "string")))
    texts = lambda v, at: F.try_variant_get(v, at, "array<string>")
    none_null = lambda a: F.coalesce(F.forall(a, lambda x: x.isNotNull()), F.lit(True))
    short = lambda a: none_null(a) & (F.coalesce(F.size(a), F.lit(0)) <= MAX_CONTEXT_LINES)
    cited = F.forall(items("$.report.evidence"), lambda e: _has_form(e, "evidence") & time(e, "$.ts")
                     & short(texts(e, "$.context_before")) & short(texts(e, "$.context_after")))
    ok = (time(doc, "$.logs_manifest.time_window.start") & time(doc, "$.logs_manifest.time_window.end")
          & none_null(texts(doc, "$.report.unknowns"))
          & F.forall(items("$.logs_manifest.files"), lambda f: _has_form(f, "file"))
          & F.forall(items("$.trajectory"), lambda s: _has_form(s, "step")) & F.coalesce(cited, F.lit(True)))
    return F.coalesce(F.when(_has_form(doc, "case"), ok), F.lit(False))


def _value_codes(doc: Column) -> Column:
    """What the walk finds in a document of the plain form, in its order."""
    text = lambda at: F.try_variant_get(doc, at, "string")
    reason, version, confidence = text("$.termination_reason"), text("$.version"), F.try_variant_get(doc, "$.report.confidence", "double")
    low, high = RANGES["report.confidence"]
    tools = F.try_variant_get(doc, "$.trajectory", "array<struct<tool:string>>")
    named = F.transform(tools, lambda s, i: F.when(~s["tool"].isin(*ALLOWED["step.tool"]), F.concat(
        F.lit("enum:trajectory["), i.cast("string"), F.lit("].tool="), s["tool"])))
    single = F.array(
        F.when(~reason.isin(*ALLOWED["case.termination_reason"]), F.concat(F.lit("enum:termination_reason="), reason)),
        F.when(~version.isin(*ALLOWED["case.version"]), F.lit("version")),
        F.when((confidence < low) | (confidence > high), F.lit("range:report.confidence")))
    return F.filter(F.concat(single, named), lambda c: c.isNotNull())


def _fits(v: Column, t: Column, kind: Column) -> Column:
    """The value ``v`` of type name ``t`` can be read as ``kind``: numbers, times and booleans also from their texts."""
    text, value = F.trim(F.try_variant_get(v, "$", "string")), F.try_variant_get(v, "$", "double")
    number = t.isin("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
    flag, is_text, is_object, is_list = t == "BOOLEAN", t == "STRING", t.startswith("OBJECT"), t.startswith("ARRAY")
    forms = {
        "string": is_text,
        "integer": flag | (number & (value == F.floor(value))) | (is_text & text.rlike(r"^[-+]?[0-9]+(\.0*)?$")),
        "number": flag | number | (is_text & text.try_cast("double").isNotNull()),
        "boolean": flag | (number & value.isin(0.0, 1.0)) | (
            is_text & F.lower(text).isin("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")),
        "time": number | (is_text & _time_like(text)),
        "object": is_object,
        "text_or_object": is_text | is_object,
        "strings": is_list & F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"),
        "list": is_list,
    }
    out = F
    for name, ok in forms.items():
        out = out.when(kind == name, ok)
    return F.coalesce(out.otherwise(F.lit(True)), F.lit(False))


def _below(e: Column) -> Column:
    """Where the value of an entry stands; the fields of the case itself are named without it."""
    return F.when(e["level"] == "case", e["key"]).otherwise(F.concat_ws(".", e["place"], e["key"]))


def _entry_codes(e: Column) -> Column:
    rule, here, text = e["rule"], F.concat_ws(".", e["place"], e["key"]), F.try_variant_get(e["value"], "$", "string")
    number = F.try_variant_get(e["value"], "$", "double")
    void = e["type"] == "VOID"
    listed = F.try_variant_get(e["value"], "$", "array<variant>")
    named = F.concat(F.lit("enum:"), _below(e), F.lit("="), F.coalesce(text, F.lit("?")))
    items = F.when(rule["items"].isNotNull() & e["type"].startswith("ARRAY"), F.filter(F.transform(
        listed, lambda x, i: F.when(~F.schema_of_variant(x).startswith("OBJECT"), F.concat(F.lit("type:"), _below(e), F.lit("["), i.cast("string"), F.lit("]")))),
        lambda c: c.isNotNull()))
    own = F.array(
        F.when(void & ~rule["nullable"], F.concat(F.lit("null:"), here)),
        F.when(~void & ~_fits(e["value"], e["type"], rule["kind"]), F.concat(F.lit("type:"), here)),
        F.when(rule["allowed"].isNotNull(), F.when(~F.coalesce(F.array_contains(rule["allowed"], text), F.lit(False)),
                                                   F.when(here == "case.version", F.lit("version")).otherwise(named))),
        F.when(rule["low"].isNotNull(), F.when((number < rule["low"]) | (number > rule["high"]), F.concat(F.lit("range:"), here))),
        F.when(rule["most"].isNotNull(), F.when(F.size(listed) > rule["most"], F.concat(F.lit("max_items:"), here))))
    unbound = rule["allowed"].isNull() & rule["low"].isNull() & rule["most"].isNull() & rule["items"].isNull()
    plain = unbound & F.coalesce(((rule["kind"] == "string") & (e["type"] == "STRING")) | ((rule["kind"] == "integer") & (e["type"] == "BIGINT")), F.lit(False))
    return F.when(rule.isNotNull() & ~plain, F.concat(F.filter(own, lambda c: c.isNotNull()), F.coalesce(items, _none())))


def with_violations(cases: DataFrame, doc: str = "doc") -> DataFrame:
    """``cases`` with ``violations``: the codes of everything in the document that the rules do not allow, empty if it is
    a valid case file. A null document is no object. Extra columns stay."""
    rules, levels = _rule_table()
    obj = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    root, walked = F.col("_root"), F.col("_root").isNotNull()
    out = staged(cases, _plain=_plain(F.col(doc)))
    out = staged(out, _root=F.when(~F.col("_plain"), obj(F.col(doc))))
    out = staged(out, _nodes=F.when(walked, F.array(F.struct(F.lit("case").alias("level"), F.lit("case").alias("place"), root.alias("fields")))),
                 _codes=F.when(F.col("_plain"), _value_codes(F.col(doc))).when(~walked, F.array(F.lit("not_an_object"))).otherwise(_none()))
    out = out.drop("_plain", "_root")
    for depth in range(DEPTH):
        def node_codes(n: Column) -> Column:
            rule, keys = levels[n["level"]], F.map_keys(n["fields"])
            extra = F.when(~rule["open"], F.array_sort(F.array_except(keys, rule["known"])))
            return F.concat(
                F.transform(F.array_except(rule["required"], keys), lambda k: F.concat(F.lit("missing:"), n["place"], F.lit("."), k)),
                F.when(F.size(extra) > 0, F.array(F.concat(F.lit("unknown_key:"), n["place"], F.lit(":"), F.array_join(extra, ",")))).otherwise(_none()))

        def entries(n: Column) -> Column:
            return F.transform(F.map_entries(n["fields"]), lambda e: F.struct(
                n["level"].alias("level"), n["place"].alias("place"), e["key"].alias("key"), e["value"].alias("value"),
                F.schema_of_variant(e["value"]).alias("type"), rules[F.concat_ws(".", n["level"], e["key"])].alias("rule")))

        def below(e: Column) -> Column:
            one = F.array(F.struct(e["rule"]["object"].alias("level"), _below(e).alias("place"), obj(e["value"]).alias("fields")))
            several = F.transform(F.try_variant_get(e["value"], "$", "array<variant>"), lambda x, i: F.struct(
                e["rule"]["items"].alias("level"), F.concat(_below(e), F.lit("["), i.cast("string"), F.lit("]")).alias("place"), obj(x).alias("fields")))
            return F.when(e["rule"]["object"].isNotNull(), one).when(e["rule"]["items"].isNotNull(), several)

        nodes = F.coalesce("_nodes", F.array().cast(out.schema["_nodes"].dataType))
        out = staged(out, _entries=F.flatten(F.transform(nodes, entries)), _more=F.flatten(F.transform(nodes, node_codes)))
        found = F.flatten(F.filter(F.transform("_entries", _entry_codes), lambda c: c.isNotNull()))
        if depth + 1 < DEPTH:
            nested = F.flatten(F.filter(F.transform("_entries", below), lambda c: c.isNotNull()))
            step = {"_next": F.filter(nested, lambda n: n["fields"].isNotNull())}
        else:
            step = {}
        out = staged(out, _found=F.concat("_codes", "_more", found), **step).drop("_codes", "_more", "_entries", "_nodes")
        out = out.withColumnsRenamed({"_found": "_codes", "_next": "_nodes"})
    return out.withColumnRenamed("_codes", "violations")
