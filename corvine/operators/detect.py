"""Entry points, roles of functions, HTTP endpoints and execution flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.operators import expand

#: Words that make a function an entry point, by language in order, and words of roles in order.
ENTRY_WORDS = {
    "go": [("http_handler", ["Handle", "Handler", "ServeHTTP", "MakeHTTPHandler"]), ("main_function", ["main"])],
    "javascript": [("http_handler", ["app.get", "app.post", "app.put", "app.delete", "router.get", "router.post", "express()"]), ("main_function", ["main", "start", "init"])],
    "java": [("http_handler", ["@GetMapping", "@PostMapping", "@PutMapping", "@DeleteMapping", "@RequestMapping", "@RestController"]), ("main_function", ["main"])],
}
ROLE_WORDS = [
    ("validation", ["validate", "check", "verify", "ensure", "assert", "sanitize", "normalize"]),
    ("data_access", ["get", "find", "fetch", "load", "save", "update", "delete", "insert", "query", "repository", "dao"]),
    ("processing", ["process", "handle", "execute", "compute", "calculate", "transform", "convert", "parse"]),
    ("response", ["response", "reply", "return", "send", "write", "encode", "serialize", "marshal"]),
    ("error_handler", ["error", "catch", "recover", "panic", "exception"]),
]
CALL_WORDS = [("validation", ["valid", "check", "verify"]), ("authorization", ["author", "auth"]), ("logging", ["log", "debug"]), ("error_handling", ["error", "err"])]


def _any(cols: list[tuple[Column, bool]], words: list[str]) -> Column:
    out = F.lit(False)
    for c, low in cols:
        for w in words:
            out = out | F.coalesce(F.contains(c, F.lit(w.lower() if low else w)), F.lit(False))
    return out


def _first(choices: list[tuple[str, Column]], default: str | None) -> Column:
    c = None
    for name, hit in choices:
        c = F.when(hit, name) if c is None else c.when(hit, name)
    return c.otherwise(F.lit(default))


def entry_point() -> Column:
    """The entry type of a unit by its language's words in name, code or signature; null for none."""
    choices = []
    for lang, types in ENTRY_WORDS.items():
        for kind, words in types:
            hit = _any([(F.lower("name"), True), (F.col("code"), False), (F.col("signature"), False)], words)
            choices.append((kind, (F.lower(F.trim("language")) == lang) & hit))
    return _first(choices, None)


def role(name: Column) -> Column:
    """D3: the role of a function by words in its name; processing without any."""
    return _first([(r, _any([(F.lower(name), True)], w)) for r, w in ROLE_WORDS], "processing")


def call_kind(call: Column) -> Column:
    """What a call is for, by words in it."""
    return _first([(r, _any([(F.lower(call), True)], w)) for r, w in CALL_WORDS], "processing")


def http_method_loose(code: Column) -> Column:
    """The first HTTP verb whose letters stand anywhere in the code."""
    return _first([(v, F.contains(F.lower(code), F.lit(v.lower()))) for v in ("GET", "POST", "PUT", "DELETE", "PATCH")], None)


def http_endpoints(code: DataFrame, key: str) -> DataFrame:
    """(key, method, path) of endpoints declared in code, by the patterns of each language."""
    pats = [
        ("go", r'r\.Methods\("([A-Z]+)"\)\.Path\("(/[^"]+)"\)\.Handler', None),
        ("javascript", r"""(?i)(?:app|router)\.(get|post|put|delete|patch)\(['"]([^'"]+)['"]""", None),
        *[("java", rf"""@({v})Mapping\(['"]([^'"]+)['"]""", v) for v in ("Get", "Post", "Put", "Delete")],
    ]
    out = None
    for lang, p, _ in pats:
        found = code.where(F.lower(F.trim("language")) == lang).select(key, F.explode(F.arrays_zip(F.regexp_extract_all("code", F.lit(p), 1).alias("m"), F.regexp_extract_all("code", F.lit(p), 2).alias("p"))).alias("x"))
        rows = found.select(key, F.upper("x.m").alias("method"), F.col("x.p").alias("path"))
        out = rows if out is None else out.unionByName(rows)
    return out


def flows(n: DataFrame, e: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node_count, max_depth) of the functions that each entry reaches over calls, all entries at once."""
    r = expand.reach(e.where("type = 'CALLS'"), starts, depth)
    return r.groupBy("start").agg(F.count("*").alias("node_count"), F.max("depth").alias("max_depth"))


def handler_chain(code: Column, path: str) -> Column:
    """Decoder, endpoint and encoder of a Go route, in the order of the call; null without the route."""
    quoted = path.replace("\\", "\\\\").replace(".", "\\.")
    p = rf'Path\("{quoted}"\)\.Handler\([^)]*\((?:e\.(\w+)Endpoint)\),\s*(\w+),\s*(\w+)'
    part = lambda k: F.nullif(F.regexp_extract(code, p, k), F.lit(""))
    return F.when(part(1).isNotNull(), F.array(part(2), part(1), part(3)))


def request_flows(units: DataFrame) -> DataFrame:
    """A row for each endpoint (D7) in a handler-like unit, with its handler chain (D8, Go) and the number, the first
    five and the kinds (D9) of the calls of the endpoint's function: the one of its name in the namespace, else with
    ``Endpoint`` behind it, the smallest id of several. ``units`` has the language by D7's names."""
    like = F.contains("name", F.lit("Handler")) | F.contains("name", F.lit("MakeHTTP")) | (F.col("name") == "main")
    u = units.where(like & F.col("code").isNotNull())
    found = http_endpoints(u, "id").join(u.select("id", "namespace", F.col("name").alias("entry_function"), "file_path", "line_start", "language", "code"), "id")
    quoted = F.concat(F.lit(r"Path\(\"\Q"), F.replace("path", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\"\)\.Handler\([^)]*\((?:e\.(\w+)Endpoint)\),\s*(\w+),\s*(\w+)"))
    part = lambda k: F.when(F.col("language") == "go", F.nullif(F.call_function("regexp_extract", F.col("code"), quoted, F.lit(k)), F.lit("")))
    found = found.withColumns({"endpoint": part(1), "decoder": part(2), "encoder": part(3)}).drop("code")
    target = units.where(F.col("type").isin("Function", "Method")).groupBy("namespace", "name").agg(F.min_by(F.struct("id", "calls"), "id").alias("t"))
    for k, end in (("a", ""), ("b", "Endpoint")):
        found = found.withColumn("_name", F.concat("endpoint", F.lit(end))).join(target.select("namespace", F.col("name").alias("_name"), F.col("t").alias(k)), ["namespace", "_name"], "left").drop("_name")
    t = F.coalesce("a", "b")
    calls = F.coalesce(t["calls"], F.array().cast("array<string>"))
    first = F.array_join(F.transform(F.slice(calls, 1, 5), lambda c: F.concat(c, F.lit(" ("), call_kind(c), F.lit(")"))), ", ")
    return found.select(F.col("id").alias("entry_id"), "namespace", "entry_function", "file_path", "line_start", "method", "path", "decoder", "endpoint", "encoder", t["id"].alias("endpoint_id"), F.size(calls).alias("n_calls"), first.alias("first_calls"))


def outline(reached: DataFrame, n: DataFrame) -> DataFrame:
    """(start, depth, line) of reached functions, indented by their depth."""
    names = n.select(F.col("id").alias("node"), "name")
    return reached.join(names, "node").select("start", "node", "depth", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), F.col("name")).alias("line"))
