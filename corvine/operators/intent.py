"""Routing of questions: intents by ordered patterns, and the entities in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Intents in order with their confidence, whether they need graph and vector, and their patterns.
INTENTS = [
    ("find_function", 0.9, True, True, ["(find|show|locate|where is).*function", "function.*called", "function.*named"]),
    ("find_class", 0.9, True, True, ["(find|show|locate).*class", "class.*called", "class.*named"]),
    ("explain_code", 0.85, True, True, ["what does.*do", "how does.*work", "explain", "understand"]),
    ("find_usage", 0.9, True, False, ["where.*used", "who calls", "called by", "usage of", "references to"]),
    ("trace_calls", 0.9, True, False, ["call chain", "call stack", "call graph", "execution path", "trace.*call"]),
    ("find_flow", 0.95, True, True, ["(deployment|execution|process) flow", "steps.*process", "workflow", "sequence.*steps"]),
    ("find_dependencies", 0.9, True, True, ["depend(s|encies)", "what.*need", "prerequisite", "must.*before", "required.*run"]),
    ("parallel_steps", 0.95, True, True, ["(run|execute).*parallel", "parallel.*step", "can.*same time", "concurrent", "simultaneously"]),
    ("optimize_flow", 0.85, True, True, ["optimi[zs]e", "improve.*performance", "faster", "reduce.*time", "speed up"]),
    ("find_docs", 0.9, False, True, ["documentation", "readme", "guide", "tutorial"]),
    ("explore_module", 0.85, True, False, ["what.*in.*module", "show me.*file", "list.*function", "overview.*module"]),
]
DEFAULT = ("general_question", 0.5, True, True)
NAMED = ("find_function", "find_class", "find_usage", "trace_calls")
COMMON_WORDS = ("the", "a", "an", "is", "are", "function", "class", "called", "named")


def classify(text: Column) -> dict[str, Column]:
    """Intent, confidence and needs of a question; the first pattern that is found wins, null is general."""
    names = ("intent", "confidence", "requires_graph", "requires_vector")
    row = lambda r: F.struct(*[F.lit(v).alias(k) for k, v in zip(names, r, strict=False)])
    low, found = F.lower(text), None
    for r in INTENTS:
        hit = low.rlike("|".join(f"(?:{p})" for p in r[4]))
        found = F.when(hit, row(r)) if found is None else found.when(hit, row(r))
    found = found.otherwise(row(DEFAULT))  # one choice, of which each column takes a part
    return {k: found[k] for k in names}


def entity_name(text: Column, intent: Column) -> Column:
    """I4: for intents about a name, the first quoted text, else the last identifier that is no common word."""
    quoted = F.nullif(F.regexp_extract(text, "[\"']([^\"']+)[\"']", 1), F.lit(""))
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"\b([a-z_][a-z0-9_]*)\b"), 1), lambda w: ~w.isin(*COMMON_WORDS))
    return F.when(intent.isin(*NAMED), F.coalesce(quoted, F.try_element_at(words, F.lit(-1))))


def entity_path(text: Column) -> Column:
    """The first path of a Python file, else JavaScript, else TypeScript."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, rf"([\w/]+\.{e})", 1), F.lit("")) for e in ("py", "js", "ts")])


def entity_numbers(text: Column) -> Column:
    """All whole numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d+)\b"), 1), lambda x: x.try_cast("bigint"))
