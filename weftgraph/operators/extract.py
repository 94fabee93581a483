"""From a table of files to symbols: ``files → lines → rules → blocks → nodes``.

The job shuffles the files once, by (repo, file_path); every window and join
after that is keyed by the file.
"""

from __future__ import annotations

import ast
import warnings
from functools import wraps

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from weftgraph.functions import contracts as c
from weftgraph.functions.let import let
from weftgraph.operators import rules as p
from weftgraph.operators.blocks import UNIT, block_ends, end_line
from weftgraph.schema import EDGES, NODES, conform, node_id
from weftgraph.session import materialise
from weftgraph.sources.files import language_of, split_lines

FILE = ["repo", "file_path"]
GO_FUNC = next(r.pattern for r in p.RULES if r.lang == "go" and r.role == "func")
START = "struct<role:string,kind:string,name:string,route:string,verb:string,ending:string,rank:int>"

PY_FACTS = T.StructType([
    T.StructField("parsed", T.BooleanType()),
    T.StructField("imports", T.ArrayType(T.StringType())),
    T.StructField("symbols", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("decorators", T.ArrayType(T.StringType())),
        T.StructField("bases", T.ArrayType(T.StringType())),
        T.StructField("parent", T.StringType()),
        T.StructField("parent_start", T.IntegerType()),
    ]))),
])


def _python_facts(text: str | None) -> tuple:
    """Top-level symbols of one Python text, or ``(False, …)`` if it is broken."""
    if text is None:
        return (None, None, None)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            body = ast.parse(text).body
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return (False, None, None)  # the line rules read the text instead
    imports, symbols = [], []

    def add(item, kind, parent=None):
        is_class = kind == "class"
        symbols.append({
            "name": item.name, "kind": kind, "start": item.lineno, "end": item.end_lineno,
            "docstring": ast.get_docstring(item) or "",
            "decorators": [] if is_class else [ast.unparse(d) for d in item.decorator_list],
            "bases": [ast.unparse(b) for b in item.bases] if is_class else None,
            "parent": parent and parent.name, "parent_start": parent and parent.lineno})

    for item in body:
        if isinstance(item, ast.Import):
            imports += [alias.name for alias in item.names]
        elif isinstance(item, ast.ImportFrom) and item.module:
            imports += [item.module] + [f"{item.module}.{alias.name}" for alias in item.names]
        elif isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef)):
            add(item, "function")
        elif isinstance(item, ast.ClassDef):
            add(item, "class")
            for inner in item.body:
                if isinstance(inner, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    add(inner, "method", item)
    return (True, imports, symbols)


@F.pandas_udf(PY_FACTS)
def python_facts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_python_facts(t) for t in texts], columns=[f.name for f in PY_FACTS.fields])


def _cached(build):
    """Build a large expression once per Spark context, not once per call."""
    made: dict[int, Column] = {}

    @wraps(build)
    def get() -> Column:
        key = id(SparkContext._active_spark_context)
        if key not in made:
            made[key] = build()
        return made[key]

    return get


# --- units ------------------------------------------------------------------

def script_blocks(html: Column) -> Column:
    """``(text, line offset)`` of every script element's body."""
    whole = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*>.*?</script>"), F.lit(0))
    pieces = F.split(html, r"(?is)<script[^>]*>.*?</script>")

    def newlines(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))

    def block(tag: Column, i: Column) -> Column:
        ahead = newlines(F.array_join(F.slice(pieces, 1, i + 1), "")) + newlines(F.array_join(F.slice(whole, F.lit(1), i), ""))
        opening = F.regexp_extract(tag, r"(?is)^<script[^>]*>", 0)
        return F.struct(
            F.regexp_extract(tag, r"(?is)^<script[^>]*>(.*?)</script>$", 1).alias("text"),
            (ahead + newlines(opening)).cast("int").alias("line_offset"))

    return F.transform(whole, block)


def notebook_code(text: Column) -> Column:
    """Code cells of a notebook, each followed by a newline; null if broken."""
    cells = F.from_json(F.get_json_object(text, "$.cells"), "array<struct<cell_type:string,source:variant>>")
    code = F.filter(cells, lambda x: x["cell_type"] == "code")

    def source(cell: Column) -> Column:
        # a string is kept as it is, also one that looks like a list
        lines = F.try_variant_get(cell["source"], "$", "array<string>")
        joined = F.coalesce(F.array_join(lines, ""), F.try_variant_get(cell["source"], "$", "string"))
        return F.concat(joined, F.lit("\n"))

    return F.array_join(F.transform(code, source), "")


def raw_parts(files: DataFrame) -> DataFrame:
    """``(repo, file_path, parts)``: the texts to read of each file.

    A single-file component yields one part per script block, a notebook its
    code; a component also yields a ``spare`` part that only counts when the
    others gave no symbol.
    """
    base = files.select(*FILE, language_of(F.col("file_path")).alias("lang"), "content")

    def part(lang: Column, text: Column, offset: Column, spare: bool) -> Column:
        return F.struct(lang.alias("lang"), text.alias("content"), offset.cast("int").alias("line_offset"), F.lit(spare).alias("spare"))

    whole = F.array(part(F.lit("generic"), F.col("content"), F.lit(0), True))
    scripts = F.transform(script_blocks(F.col("content")), lambda b: part(F.lit("ts"), b["text"], b["line_offset"], False))
    notebook = let(notebook_code(F.col("content")), lambda code: F.when(
        F.coalesce(F.length(F.regexp_replace(code, r"\s", "")) > 0, F.lit(False)),
        F.array(part(F.lit("python"), code, F.lit(0), False))).otherwise(whole))
    return base.select(*FILE, (
        F.when(F.col("lang") == "vue", F.concat(scripts, whole))
        .when(F.col("lang") == "notebook", notebook)
        .otherwise(F.array(part(F.col("lang"), F.col("content"), F.lit(0), False)))).alias("parts"))


def syntax_facts(files: DataFrame) -> DataFrame:
    """``(repo, file_path, parsed, imports, symbols)`` of the Python texts.

    The only Python code in the extraction; written out, so that each text is
    parsed exactly once although two branches use the result.
    """
    python = files.where(language_of(F.col("file_path")).isin("python", "notebook"))
    text = raw_parts(python).select(*FILE, F.get("parts", F.lit(0)).alias("p")).where("p.lang = 'python'")
    return materialise(text.select(*FILE, python_facts(F.col("p.content")).alias("py")).select(*FILE, "py.*"), "syntax")


def code_parts(files: DataFrame) -> DataFrame:
    """``(repo, file_path, parts)`` with the lines and imports of each part,
    worked out once per text."""
    return raw_parts(files).select(*FILE, _split_parts().alias("parts"))


def look_back(lines: Column, line_no: Column, above: int | Column) -> Column:
    """A line and the ``above`` lines before it, as one text."""
    return _joined(lines, line_no - above, line_no)


def file_imports(lang: Column, content: Column, lines: Column) -> Column:
    """Imported names of a text, in order. Java has none; those of Python come
    from its syntax tree."""
    def by_line(pattern: str) -> Column:
        return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")

    def go_block(text: Column) -> Column:
        quoted = F.transform(split_lines(text), lambda x: F.regexp_extract(x, r'"([^"]+)"', 1))
        return F.when(text.rlike(r"^import\s*\("), quoted).otherwise(F.array(F.regexp_extract(text, r'"([^"]+)"', 1)))

    go = F.filter(F.flatten(F.transform(F.regexp_extract_all(content, F.lit(p.GO_IMPORT), F.lit(0)), go_block)), lambda x: x != "")
    out = F.when(lang == "go", go)
    for name, pattern in p.LINE_IMPORTS.items():
        out = out.when(lang == name, by_line(pattern))
    for name, pattern in p.TEXT_IMPORTS.items():
        out = out.when(lang == name, F.regexp_extract_all(content, F.lit(pattern), F.lit(1)))
    return out


# --- declarations -----------------------------------------------------------

def _slug(verb: Column, route: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(route, "[^a-zA-Z0-9_]", "_"), "^_+|_+$", "")
    return F.concat(F.lit("route_"), F.lower(verb), F.lit("_"), clean)


def _rule_start(rule: p.Rule, line: Column, rank: int) -> Column:
    """Struct of a declaration found by one rule, or null."""
    def start(found: Column) -> Column:
        verb = F.upper(F.regexp_extract(line, rule.pattern, rule.verb)) if rule.verb else F.lit(None)
        name = _slug(verb, found) if rule.verb else found
        usable = found != ""
        if rule.not_names:
            usable = usable & ~(F.lower(found) if rule.fold_names else found).isin(*rule.not_names)
        return F.when(usable, F.struct(
            F.lit(rule.role).alias("role"), F.lit(rule.kind).alias("kind"), name.alias("name"),
            (found if rule.verb else F.lit(None)).cast("string").alias("route"), verb.cast("string").alias("verb"),
            F.lit(rule.end).alias("ending"), F.lit(rank).alias("rank"))).cast(START)

    return let(F.regexp_extract(line, rule.pattern, rule.group), start)


def declarations(lang: Column, line: Column) -> Column:
    """Array of the declarations on a line, by the rules of its language."""
    out = F.lit(None).cast(f"array<{START}>")
    for name in dict.fromkeys(rule.lang for rule in p.RULES):
        groups: dict[str, list[Column]] = {}
        for rank, rule in enumerate(r for r in p.RULES if r.lang == name):
            groups.setdefault(rule.pick or str(rank), []).append(_rule_start(rule, line, rank))
        picked = [g[0] if len(g) == 1 else F.coalesce(*g) for g in groups.values()]
        out = F.when(lang == name, F.array_compact(F.array(*picked))).otherwise(out)
    return F.coalesce(out, F.array().cast(f"array<{START}>"))


def _joined(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, clipped to the text."""
    start = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(lines, start, F.greatest(F.least(last, F.size(lines)) - start + 1, F.lit(0))), "")


@_cached
def _split_parts() -> Column:
    def split(part: Column) -> Column:
        return let(split_lines(part["content"]), lambda lines: F.struct(
            part["lang"].alias("lang"), lines.alias("lines"), file_imports(part["lang"], part["content"], lines).alias("imports"),
            part["line_offset"].alias("line_offset"), part["spare"].alias("spare")))

    return F.transform("parts", split)


@_cached
def _marked_lines() -> Column:
    return F.transform("lines", lambda x: F.struct(x.alias("line"), declarations(F.col("lang"), x).alias("starts")))


@_cached
def _contract() -> Column:
    inputs = ("lang", "role", "block", "line", "above", "class_above", "name", "file_path", "route", "verb")
    return let(F.struct(*inputs), _rule_contract)


def _rule_nodes(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """Declarations of all languages that are read by rules, with their texts.

    ``placed`` is partitioned by file; both uses read the same shuffle.
    """
    parts = code_parts(placed)
    broken = facts.where(~F.col("parsed")).select(*FILE, F.lit(True).alias("broken"))
    # parts are never empty; the outer form keeps a size filter from being
    # pushed below the shuffle
    each = raw_parts(placed).join(broken, FILE, "left").select(*FILE, "broken", F.posexplode_outer("parts").alias("unit", "p")).select(
        *UNIT, F.when(F.col("broken"), "broken_python").otherwise(F.col("p.lang")).alias("lang"), split_lines(F.col("p.content")).alias("lines"))
    # a Python text that parses has no rules and yields no lines here
    ruled = F.when(F.col("lang") != "python", _marked_lines())
    lined = each.select(*UNIT, "lang", F.posexplode(ruled).alias("i", "l")).select(
        *UNIT, "lang", (F.col("i") + 1).alias("line_no"), "l.line", "l.starts")
    found = block_ends(lined)
    start = F.col("start_line")
    both = found.join(parts, FILE).withColumn("p", F.element_at("parts", F.col("unit") + 1)).select(
        *UNIT, "lang", "style", "start_line", "start.*", "block_end", "p.lines", "p.imports", "p.line_offset", "p.spare")
    near = _joined(F.col("lines"), start, start + 2).contains("{")
    # a C declaration needs a body: a { before any ; within five lines
    marks = F.filter(F.slice("lines", start, F.lit(5)), lambda x: x.contains("{") | x.contains(";"))
    has_body = F.coalesce(F.try_element_at(marks, F.lit(1)).contains("{"), F.lit(False))
    ends = both.where((F.col("lang") != "c") | has_body).withColumn(
        "end_line", end_line(start, F.col("block_end"), F.col("style"), F.size("lines"), F.col("ending"), near))
    texted = ends.select(
        *UNIT, "lang", "start_line", "role", "kind", "name", "route", "verb", "rank", "end_line", "line_offset", "spare",
        "imports", _joined(F.col("lines"), start, F.col("end_line")).alias("block"),
        F.element_at("lines", start).alias("line"),
        look_back(F.col("lines"), start, F.when(F.col("lang") == "go", 5).otherwise(3)).alias("above"))
    whole = Window.partitionBy(*UNIT)
    first_type = F.min(F.when(F.col("role") == "type", start)).over(whole)
    return texted.withColumn("first_type", first_type).withColumn(
        "class_above", F.max(F.when((F.col("role") == "type") & (start == F.col("first_type")), F.col("above"))).over(whole))


def _rule_contract(x: Column) -> Column:
    """Endpoint, client call and receiver of one declaration."""
    lang, block, line, above = x["lang"], x["block"], x["line"], x["above"]
    is_func = x["role"] == "func"
    end = (F.when(x["role"] == "route", c.endpoint(x["route"], x["verb"]))
           .when(~is_func, F.lit(None))
           .when(lang == "ts", c.ts_endpoint(line, above, x["name"], x["file_path"]))
           .when(lang == "go", c.go_endpoint(block, above))
           .when(lang == "java", c.java_endpoint(above, x["class_above"]))
           .when(lang == "rust", c.rust_endpoint(above))
           .when(lang == "csharp", c.csharp_endpoint(above))
           .when(lang == "generic", c.generic_endpoint(line)))
    use = F.when(~is_func, F.lit(None)).when(lang == "ts", c.ts_consumer(block)).when(lang == "go", c.go_consumer(block))
    for name in p.PLAIN_CLIENTS:
        use = use.when(lang == name, c.plain_consumer(block, name))
    receiver = F.when((lang == "go") & is_func, F.nullif(F.regexp_extract(line, GO_FUNC, 1), F.lit("")))
    return F.struct(end.alias("end"), use.alias("use"), receiver.alias("receiver"))


def _rule_symbols(texted: DataFrame) -> DataFrame:
    """Adds contract attributes and shapes rule symbols as nodes."""
    full = texted.withColumn("found", _contract()).select("*", "found.*").drop("found")
    lang, role, block, line = (F.col(x) for x in ("lang", "role", "block", "line"))
    kind = F.when(F.col("end").isNotNull(), "endpoint").when(F.col("receiver").isNotNull(), "method").otherwise(F.col("kind"))
    # a C file lists its includes on its first symbol only
    nth = F.row_number().over(Window.partitionBy(*UNIT).orderBy("start_line", "rank"))
    has_imports = ~lang.isin("java", "broken_python") & ((lang != "c") | (F.col("nth") == 1))
    name = F.when(lang == "c", F.substring_index("name", "::", -1)).otherwise(F.col("name"))
    coded = role.isin("func", "route", "struct")
    # a spare part counts only when no other part of the file gave a symbol
    main = F.max(~F.col("spare")).over(Window.partitionBy(*FILE))
    kept = full.withColumn("nth", nth).withColumn("main", main).where(~F.col("spare") | ~F.col("main"))
    return kept.select(
        *FILE, name.alias("symbol_name"), kind.alias("symbol_type"),
        (F.col("start_line") + F.col("line_offset")).alias("start_line"), (F.col("end_line") + F.col("line_offset")).alias("end_line"),
        F.regexp_replace(line, r"(?U)^\s+|\s+$", "").alias("signature"), F.lit("").alias("docstring"),
        F.when(coded, block).otherwise("").alias("code_content"), "end.endpoint_route", "end.http_method", "use.consumes_endpoint",
        "use.consumes_http_method", "use.target_base_url", F.when(has_imports, F.col("imports")).alias("file_imports"), "receiver")


def _python_symbols(placed: DataFrame, facts: DataFrame) -> DataFrame:
    """Symbols of Python texts, from the syntax tree's facts."""
    def text(s: Column) -> Column:
        return F.struct(
            s.alias("s"), F.array_join(F.slice("lines", s["start"], s["end"] - s["start"] + 1), "").alias("block"),
            F.try_element_at("lines", s["start"]).alias("line"))

    lined = raw_parts(placed).join(facts.where("parsed"), FILE).select(
        *FILE, "imports", "symbols", split_lines(F.get("parts", F.lit(0))["content"]).alias("lines"))
    each = lined.select(*FILE, "imports", F.explode(F.transform("symbols", text)).alias("t")).select(
        *FILE, "imports", "t.s.*", "t.block", "t.line")

    def contract(x: Column) -> Column:
        end = F.when(x["kind"] != "class", c.python_endpoint(x["decorators"]))
        return let(end, lambda e: F.struct(
            e.alias("end_"), F.when((x["kind"] != "class") & e.isNull(), c.python_consumer(x["block"])).alias("use")))

    shaped = each.withColumn("found", let(F.struct("kind", "decorators", "block"), contract)).select("*", "found.*").drop("found")
    return shaped.select(
        *FILE, F.col("name").alias("symbol_name"),
        F.when(F.col("end_").isNotNull(), "endpoint").otherwise(F.col("kind")).alias("symbol_type"),
        F.col("start").alias("start_line"), F.col("end").alias("end_line"),
        F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("signature"), "docstring", F.col("block").alias("code_content"),
        "end_.endpoint_route", "end_.http_method", "use.consumes_endpoint", "use.consumes_http_method", "use.target_base_url",
        F.col("imports").alias("file_imports"), F.col("parent").alias("parent_class"), "parent_start", "bases")


def extract_symbols(files: DataFrame) -> DataFrame:
    """``files(repo, file_path, content)`` → nodes, plus ``parent_id``.

    ``parent_id`` is the class of a Python method.
    """
    # never null, so that no branch adds a null filter of its own below the
    # shuffle: branches that differ there do not share it
    path = F.regexp_replace(F.translate("file_path", "\\", "/"), "^/+|/+$", "")
    clean = files.select(F.coalesce("repo", F.lit("")).alias("repo"), F.coalesce(path, F.lit("")).alias("file_path"), "content")
    facts = syntax_facts(clean)
    # only plain columns below the shuffle: branches that hold the same shuffle
    # share it, and lambda variables would make them look different
    placed = clean.repartition(*FILE)
    found = _rule_symbols(_rule_nodes(placed, facts)).unionByName(_python_symbols(placed, facts), allowMissingColumns=True)
    nid = node_id(F.col("repo"), F.col("file_path"), F.col("symbol_name"), F.col("start_line"))
    parent = F.when(F.col("parent_start").isNotNull(), node_id(F.col("repo"), F.col("file_path"), F.col("parent_class"), F.col("parent_start")))
    return conform(found.withColumn("id", nid).withColumn("parent_id", parent), T.StructType([*NODES.fields, T.StructField("parent_id", T.StringType())]))


def defines_edges(symbols: DataFrame) -> DataFrame:
    """Class → method; the class id is already on the method's row."""
    return conform(symbols.where(F.col("parent_id").isNotNull()).select(
        F.col("parent_id").alias("caller_id"), F.col("id").alias("callee_id"),
        F.lit("defines").alias("edge_type"), F.lit(1.0).alias("confidence")), EDGES)


def intra_file_calls(symbols: DataFrame) -> DataFrame:
    """Calls between symbols of one Python file, by name.

    A name stands for its last symbol in the file; a symbol of the same name
    as the callee makes no edge.
    """
    python = symbols.where(language_of(F.col("file_path")).isin("python", "notebook") & (F.col("code_content") != ""))
    names = symbols.groupBy(*FILE, F.col("symbol_name").alias("called")).agg(F.max_by("id", "start_line").alias("callee_id"))
    calls = python.select(*FILE, F.col("id").alias("caller_id"), "symbol_name", F.explode(F.array_distinct(
        F.regexp_extract_all("code_content", F.lit(r"(?U)\b(\w+)\("), F.lit(1)))).alias("called")).where("called <> symbol_name")
    return conform(calls.join(names, [*FILE, "called"]).select(
        "caller_id", "callee_id", F.lit("calls").alias("edge_type"), F.lit(1.0).alias("confidence")), EDGES)


def inherits_edges(symbols: DataFrame) -> DataFrame:
    """Optional: class → base class of the same name within the repository."""
    bases = symbols.where(F.size("bases") > 0).select("repo", F.col("id").alias("caller_id"), F.explode("bases").alias("base"))
    classes = symbols.where(F.col("symbol_type") == "class").groupBy("repo", F.col("symbol_name").alias("base")).agg(
        F.min("id").alias("callee_id"))
    return conform(bases.join(classes, ["repo", "base"]).select(
        "caller_id", "callee_id", F.lit("inherits").alias("edge_type"), F.lit(1.0).alias("confidence")), EDGES)
