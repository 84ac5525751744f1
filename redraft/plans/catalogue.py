"""Registered queries of the edit-planning operators, each over whole tables, with their SQL.

The tables hold prose, orders and events, no code; where an operator needs a
report, a lock file or a manifest, Spark derives one from their rows.
"""

from __future__ import annotations

import dataclasses
import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redraft.functions import text as tx
from redraft.functions import versions as vs
from redraft.operators import edits as ed
from redraft.operators import attempts, graph, planning, requests
from redraft.plans import plan as pl
from redraft.plans import providers
from redraft.plans.context import Context, context_table, with_context
from redraft.sources import readers, splits, writer

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Renames used throughout: (old, new, replaces all occurrences).
RENAMES = (("the", "THE", True), ("tion", "TION", True), ("there", "THERE", False), ("ationthe", "X", False))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows that take little room and much time: a file of few row groups is read by as few tasks, so they are dealt out for what follows."""
    return rows.repartition(max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.source_lines(_table(spark, sf_dir, "documents"), "doc_id", "text")


def _mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, o, n, a) for i, (o, n, a) in enumerate(RENAMES)], "ix int, old_text string, new_text string, replace_all boolean")


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).join(F.broadcast(_mappings(spark)), F.expr("contains(text, old_text)"))
    return rows.select("file", "line", (F.col("line").cast("long") * 10 + F.col("ix")).alias("seq"), "old_text", "new_text", F.concat(F.lit("r"), F.col("ix")).alias("rule_id"), "replace_all")


LINES = r"""lines AS (SELECT doc_id AS file, generate_subscripts(ls, 1) AS line, unnest(ls) AS text FROM
  (SELECT doc_id, string_split_regex(regexp_replace(text, '\r?\n$', ''), '\r?\n') AS ls FROM documents WHERE text <> ''))"""
MAPPINGS = "mappings(ix, old_text, new_text, replace_all) AS (VALUES " + ", ".join(f"({i}, '{o}', '{n}', {str(a).lower()})" for i, (o, n, a) in enumerate(RENAMES)) + ")"
EDITS = f"{LINES}, {MAPPINGS}, edits AS (SELECT file, line, CAST(line * 10 + ix AS BIGINT) AS seq, old_text, new_text, 'r' || ix AS rule_id, replace_all FROM lines JOIN mappings ON contains(text, old_text))"


@query(f"WITH {LINES} SELECT file, CAST(line AS INT) AS line, CAST(length(text) AS INT) AS n FROM lines")
def lines_explode(spark, sf_dir):
    return _lines(spark, sf_dir).select("file", "line", F.length("text").alias("n"))


@query("SELECT event_type, count(*) AS n, sum(CAST(props ->> 'k' AS BIGINT)) AS total FROM events GROUP BY event_type")
def unnest_json_variables(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select("event_type", F.explode(F.from_json("props", "map<string,variant>")).alias("name", "value")).where("name = 'k'")
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.try_variant_get("value", "$", "bigint")).alias("total"))


_KINDS = ("Rename", "RemoveProp", "CssVariablePrefix", "EnsureDependency", "UpdateType", "LlmAssisted", "Unknown")
_STRATEGIES = """s AS (SELECT 'rule-' || (p_partkey % 50) AS rule_id, arg_max(p_partkey, p_partkey) AS k FROM part GROUP BY 1),
e AS (SELECT rule_id, k, p_brand AS f, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS t, p_size % 7 AS z FROM s JOIN part ON p_partkey = k)"""


def _strategies(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_size") % 7).cast("int"))
    to = F.when(F.col("p_size") % 3 != 0, F.col("p_type"))
    none = F.lit(None).cast("array<struct<from:string,to:string,component:string,prop:string>>")
    entry = F.struct(kind.alias("strategy"), F.col("p_brand").alias("from"), to.alias("to"), F.lit(None).cast("string").alias("package"), F.lit(None).cast("string").alias("new_version"), none.alias("mappings"))
    rows = part.select(F.concat(F.lit("rule-"), (F.col("p_partkey") % 50).cast("string")).alias("rule_id"), "p_partkey", entry.alias("entry"))
    return readers.last_wins(rows, ["rule_id"], ["p_partkey"])


@query(f"WITH {_STRATEGIES} SELECT rule_id, k AS p_partkey, f AS source, t AS target FROM e")
def strategy_last_wins(spark, sf_dir):
    return _strategies(spark, sf_dir).select("rule_id", "p_partkey", F.col("entry.from").alias("source"), F.col("entry.to").alias("target"))


@query(
    f"""WITH {_STRATEGIES},
kinds AS (SELECT rule_id, CASE z WHEN 0 THEN CASE WHEN t IS NULL THEN 'Manual' ELSE 'Rename' END WHEN 1 THEN 'RemoveAttribute' WHEN 2 THEN CASE WHEN t IS NULL THEN 'Manual' ELSE 'CssVariablePrefix' END
  WHEN 3 THEN 'Manual' WHEN 4 THEN CASE WHEN t IS NULL THEN 'Manual' WHEN contains(f, ' ') OR contains(t, ' ') THEN 'Llm' ELSE 'Rename' END WHEN 5 THEN 'Llm' ELSE 'Manual' END AS kind FROM e)
SELECT l_returnflag, coalesce(kind, CASE l_linestatus WHEN 'O' THEN 'RemoveAttribute' ELSE CASE WHEN l_returnflag = 'A' THEN 'Manual' END END, 'Llm') AS kind, count(*) AS n
FROM lineitem LEFT JOIN kinds ON rule_id = 'rule-' || (l_partkey % 80) GROUP BY 1, 2"""
)
def strategy_resolve(spark, sf_dir):
    found = _strategies(spark, sf_dir).select("rule_id", planning.strategy_kind().alias("kind"))
    labels = F.array(F.lit("family=Card"), F.when(F.col("l_linestatus") == "O", "change-type=prop-removal").when(F.col("l_returnflag") == "A", "change-type=behavioral").otherwise("change-type=new"))
    rows = _table(spark, sf_dir, "lineitem").select("l_returnflag", F.concat(F.lit("rule-"), (F.col("l_partkey") % 80).cast("string")).alias("rule_id"), labels.alias("labels"))
    return planning.resolved(rows, found).groupBy("l_returnflag", "kind").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND toxic = 1)")
def only_files(spark, sf_dir):
    uri = lambda c: tx.file_uri(F.concat(F.lit("docs/"), F.col(c).cast("string")), "/data")
    wanted = _table(spark, sf_dir, "labels").where("toxic = 1").select(uri("doc_id").alias("file_uri")).distinct()
    return _table(spark, sf_dir, "documents").withColumn("file_uri", uri("doc_id")).join(wanted, "file_uri", "left_semi").select("doc_id", "lang")


@query("SELECT page_id, list_has_any(string_split(url, '/'), ['en', 'de']) AS skipped FROM pages")
def path_skip(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", tx.skips_path(F.col("url"), ("en", "de")).alias("skipped"))


@query("SELECT doc_id, md5(regexp_replace(text, 'the', 'T$E')) AS h FROM documents")
def rename_first(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.replace_first(F.col("text"), "the", "T$E").cast("binary")).alias("h"))


@query("SELECT doc_id, md5(replace(text, 'the', 'T$E')) AS h FROM documents")
def rename_all(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.replace_all(F.col("text"), "the", "T$E").cast("binary")).alias("h"))


@query(r"SELECT doc_id, md5(regexp_replace(text, '\bthe\b', 'T$E', 'g')) AS h FROM documents")
def rename_words(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(tx.replace_words(F.col("text"), "the", "T$E").cast("binary")).alias("h"))


@query(
    f"""WITH {LINES}, {MAPPINGS}, hits AS (SELECT file, line, old_text, new_text FROM lines JOIN mappings ON contains(text, old_text))
SELECT file, CAST(line AS INT) AS line, old_text, new_text FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.file = h.file AND o.line = h.line AND o.old_text <> h.old_text AND contains(o.old_text, h.old_text))"""
)
def rename_whole_file(spark, sf_dir):
    return planning.whole_file_edits(_lines(spark, sf_dir), _mappings(spark))


@query(
    f"""WITH {LINES}, {MAPPINGS}, inc AS (SELECT file, line AS incident_line FROM lines WHERE contains(text, 'idiot'))
SELECT DISTINCT i.file, CAST(incident_line AS INT) AS incident_line, CAST(line AS INT) AS line, old_text, new_text
FROM inc i JOIN lines l ON l.file = i.file AND l.line BETWEEN incident_line - 3 AND incident_line + 4 JOIN mappings ON contains(text, old_text)"""
)
def rename_neighbourhood(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    incidents = lines.where("contains(text, 'idiot')").select("file", "line", F.lit("r").alias("rule_id"))
    return planning.near_edits(incidents, lines, _mappings(spark).select(F.lit("r").alias("rule_id"), "old_text", "new_text"))


@query(
    """WITH dead AS (SELECT DISTINCT '/' || lang || '/1' AS dead FROM documents), s AS (SELECT page_id, url, replace(url, 'http://', 'https://') AS swapped FROM pages)
SELECT page_id, CASE WHEN contains(url, '?page') OR EXISTS (SELECT 1 FROM dead WHERE contains(swapped, dead)) THEN 'manual' ELSE 'rename' END AS outcome, swapped FROM s"""
)
def prefix_swap_guarded(spark, sf_dir):
    dead = _table(spark, sf_dir, "documents").select(F.concat(F.lit("/"), F.col("lang"), F.lit("/1")).alias("dead"))
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("matched"))
    return planning.prefix_swaps(pages, "http://", "https://", ("?page",), dead).select("page_id", "outcome", "swapped")


@query(
    f"""WITH {LINES}, inc AS (SELECT DISTINCT file, line AS incident_line FROM lines WHERE length(text) < 80),
near AS (SELECT i.file, incident_line, l.line, l.text FROM inc i JOIN lines l ON l.file = i.file AND l.line BETWEEN incident_line - 50 AND incident_line + 49),
agg AS (SELECT file, incident_line, max(text) FILTER (line = incident_line) AS own,
  max(CASE WHEN line < incident_line AND (contains(text, chr(123)) OR ltrim(text) LIKE 'import%' OR ltrim(text) LIKE 'export%') THEN 1 ELSE 0 END) AS blk,
  arg_min(text, line) FILTER (contains(text, 'from ') AND line >= incident_line) AS ct, min(line) FILTER (contains(text, 'from ') AND line >= incident_line) AS cl FROM near GROUP BY 1, 2)
SELECT file, CAST(incident_line AS INT) AS incident_line,
  CASE WHEN contains(own, 'the ') THEN CASE WHEN contains(own, 'of ') THEN 'already_migrated' ELSE 'edit' END WHEN blk = 0 THEN 'not_in_import_block'
    WHEN ct IS NULL OR NOT contains(ct, 'the ') THEN 'text_not_found' WHEN contains(ct, 'of ') THEN 'already_migrated' ELSE 'edit' END AS outcome,
  CAST(CASE WHEN contains(own, 'the ') THEN CASE WHEN NOT contains(own, 'of ') THEN incident_line END WHEN blk = 1 AND ct IS NOT NULL AND contains(ct, 'the ') AND NOT contains(ct, 'of ') THEN cl END AS INT) AS line
FROM agg"""
)
def import_path_scan(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    found = planning.import_changes(lines.where("length(text) < 80").select("file", "line", F.lit("the ").alias("old_text"), F.lit("of ").alias("new_text")), lines)
    return found.select("file", "incident_line", "outcome", "line")


@query(
    f"""WITH {EDITS}, n AS (SELECT e.*, EXISTS (SELECT 1 FROM edits o WHERE o.file = e.file AND o.line = e.line AND o.old_text <> e.old_text AND contains(o.old_text, e.old_text)) AS nested FROM edits e),
one AS (SELECT * FROM n WHERE NOT nested AND seq = (SELECT min(seq) FROM edits o WHERE o.file = n.file AND o.line = n.line AND o.old_text = n.old_text)),
two AS (SELECT * FROM n WHERE nested AND replace_all AND NOT EXISTS (SELECT 1 FROM one b WHERE b.file = n.file AND b.line = n.line AND NOT b.replace_all AND b.old_text <> n.old_text AND contains(b.old_text, n.old_text)))
SELECT file, CAST(line AS INT) AS line, seq, old_text, rule_id FROM one UNION ALL SELECT file, CAST(line AS INT), seq, old_text, rule_id FROM two"""
)
def edit_settle(spark, sf_dir):
    return ed.settled(_edits(spark, sf_dir)).select("file", "line", "seq", "old_text", "rule_id")


@query(f"WITH {EDITS} SELECT file, CAST(line AS INT) AS line, old_text, min(seq) AS seq, count(*) * 2 AS n FROM edits GROUP BY file, line, old_text, new_text")
def edit_repeats(spark, sf_dir):
    once = _edits(spark, sf_dir)
    twice = once.unionByName(once.withColumn("seq", F.col("seq") + 1_000_000))
    sizes = twice.groupBy("file", "line", "old_text").agg(F.count("*").alias("n"))
    return ed.without_repeats(twice).join(sizes, ["file", "line", "old_text"]).select("file", "line", "old_text", "seq", "n")


@query(
    f"""WITH {LINES} SELECT file, CAST(line AS INT) AS line, md5(replace(replace(text, 'tion', 'TION'), 'the', 'THE')) AS h FROM lines WHERE contains(text, 'the') OR contains(text, 'tion')"""
)
def edit_apply(spark, sf_dir):
    edits = _edits(spark, sf_dir).where("replace_all")
    return ed.changed_lines(ed.settled(edits), _lines(spark, sf_dir)).select("file", "line", F.md5(F.col("after").cast("binary")).alias("h"))


@query(
    f"""WITH {LINES}, z AS (SELECT file, max(line) AS t FROM lines GROUP BY 1), e AS (SELECT doc_id AS file, n_chars % 40 + 1 AS line FROM documents)
SELECT e.file, CAST(e.line AS INT) AS line, CASE WHEN l.text IS NULL THEN 'line_out_of_bounds' WHEN contains(l.text, 'the') THEN 'applied' ELSE 'text_not_found_on_line' END AS outcome, CAST(coalesce(t, 0) AS INT) AS total_lines
FROM e LEFT JOIN lines l ON l.file = e.file AND l.line = e.line LEFT JOIN z ON z.file = e.file"""
)
def edit_outcomes(spark, sf_dir):
    edits = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), (F.col("n_chars") % 40 + 1).cast("int").alias("line"), F.lit("the").alias("old_text"))
    return ed.outcomes(edits, _lines(spark, sf_dir)).select("file", "line", "outcome", "total_lines")


@query(
    f"""WITH {LINES}, a AS (SELECT file, line, contains(text, 'idiot') AS ch, CASE WHEN contains(text, 'idiot') THEN '-' || text || chr(10) || '+' || replace(text, 'idiot', 'person') ELSE ' ' || text END AS s FROM lines),
w AS (SELECT file, line, ch, list(s) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ss FROM a)
SELECT file, CAST(line AS INT) AS line, CAST(greatest(line - 3, 1) AS INT) AS first_line, CAST(len(ss) AS INT) AS n_lines, md5(array_to_string(ss, chr(10))) AS h FROM w WHERE ch"""
)
def diff_preview(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    edits = lines.where(F.contains("text", F.lit("idiot"))).select("file", "line", F.lit(1).cast("long").alias("seq"), F.lit("idiot").alias("old_text"), F.lit("person").alias("new_text"), F.lit("r").alias("rule_id"), F.lit(True).alias("replace_all"))
    return ed.diff_hunks(edits, lines).select("file", "line", "first_line", "n_lines", F.md5(F.col("hunk").cast("binary")).alias("h"))


PAGE_LINES = r"""lines AS (SELECT page_id AS file, generate_subscripts(ls, 1) AS line, unnest(ls) AS text FROM
  (SELECT page_id, string_split_regex(regexp_replace(html, '\r?\n$', ''), '\r?\n') AS ls FROM pages WHERE html <> ''))"""


@query(rf"""WITH {PAGE_LINES} SELECT file, CAST(line AS INT) AS line, md5(regexp_replace(text, '\s+class="[^"]*"', '', 'g')) AS h FROM lines WHERE text <> regexp_replace(text, '\s+class="[^"]*"', '', 'g')""")
def attribute_removal(spark, sf_dir):
    lines = readers.source_lines(_table(spark, sf_dir, "pages"), "page_id", "html")
    return planning.attribute_edits(lines, "class").select("file", "line", F.md5(F.col("new_text").cast("binary")).alias("h"))


@query(
    r"""WITH t AS (SELECT page_id, regexp_replace(html, '["''`]', '', 'g') AS x FROM pages)
SELECT page_id, CAST(length(regexp_replace(x, '[^\(\[{]', '', 'g')) - length(regexp_replace(x, '[^\)\]}]', '', 'g')) AS INT) AS depth FROM t"""
)
def bracket_depths(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", tx.bracket_depth(F.regexp_replace("html", "[\"'`]", "")).alias("depth"))


_BRACKETS = """o AS (SELECT o_custkey AS file, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS line, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS d FROM orders),
c AS (SELECT *, sum(d) OVER (PARTITION BY file ORDER BY line) AS after FROM o)"""


@query(f'WITH {_BRACKETS} SELECT s.file, CAST(s.line AS INT) AS start, CAST(min(e.line) AS INT) AS "end" FROM c s LEFT JOIN c e ON e.file = s.file AND e.line >= s.line AND e.after <= s.after - s.d WHERE s.d = 1 GROUP BY 1, 2')
def balanced_runs(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    text = F.when(F.col("o_orderstatus") == "F", "f(").when(F.col("o_orderstatus") == "O", "')'; }").otherwise("g(x)")
    lines = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), place.alias("line"), text.alias("text"))
    return planning.balanced_runs(lines.where("text = 'f('").select("file", F.col("line").alias("start")), lines)


@query(
    """WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS x, generate_subscripts(string_split(text, ' '), 1) AS i FROM conversations),
u AS (SELECT conv_id, turn, x, min(i) AS i FROM w WHERE x <> '' GROUP BY 1, 2, 3)
SELECT conv_id, turn, md5('import { ' || string_agg(x, ', ' ORDER BY i) || ' } from "x"') AS h FROM u GROUP BY 1, 2"""
)
def specifier_dedup(spark, sf_dir):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    line = F.concat(F.lit("import {"), F.array_join(F.transform(words, lambda x: F.replace(x, F.lit(","), F.lit("\u0001"))), " ,"), F.lit('} from "x"'))
    rows = _table(spark, sf_dir, "conversations").where("text rlike '[^ ]'").select("conv_id", "turn", F.replace(tx.unique_specifiers(line), F.lit("\u0001"), F.lit(",")).alias("s"))
    return rows.select("conv_id", "turn", F.md5(F.col("s").cast("binary")).alias("h"))


@query(f"WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY file, trim(text) ORDER BY line) AS k FROM lines) SELECT file, CAST(line AS INT) AS line FROM f WHERE k > 1 AND trim(text) <> ''")
def line_dedup_blank(spark, sf_dir):
    before = _lines(spark, sf_dir).where("trim(text) <> ''")
    return ed.blank_repeated_imports(before, prefix="").where("text = ''").select("file", "line")


@query("SELECT CASE event_type WHEN 'click' THEN 'text not found' WHEN 'view' THEN 'already migrated' WHEN 'purchase' THEN 'no-op rename' ELSE 'missing variable' END AS reason, count(*) AS n FROM events GROUP BY 1")
def reason_histogram(spark, sf_dir):
    reason = F.when(F.col("event_type") == "click", "text_not_found").when(F.col("event_type") == "view", "already_migrated").when(F.col("event_type") == "purchase", "no_op_rename").otherwise("missing_variable")
    words = F.create_map(*[F.lit(x) for pair in planning.SKIP_TEXTS.items() for x in pair])
    return _table(spark, sf_dir, "events").groupBy(words[reason].alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {EDITS} SELECT (SELECT count(*) FROM documents) AS files, count(*) AS edits, count(DISTINCT file) AS files_with_edits, count(*) FILTER (replace_all) AS replace_all_edits, count(DISTINCT rule_id) AS rules FROM edits")
def summary_counters(spark, sf_dir):
    files = _table(spark, sf_dir, "documents").agg(F.count("*").alias("files"))
    found = _edits(spark, sf_dir).agg(F.count("*").alias("edits"), F.count_distinct("file").alias("files_with_edits"), F.count_if("replace_all").alias("replace_all_edits"), F.count_distinct("rule_id").alias("rules"))
    return files.crossJoin(found)


def _requests(spark, sf_dir):
    family = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("F"), (F.col("event_id") % 5).cast("string")))
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.col("event_type").alias("rule_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 100).cast("int").alias("line"), F.col("props").alias("message"), F.array(F.concat(F.lit("family="), family)).alias("labels"), family.alias("family"), (F.col("event_id") % 4).cast("int").alias("priority")
    )


_REQUESTS = "r AS (SELECT user_id AS file, event_type AS rule_id, event_id AS seq, event_id % 100 AS line, props AS message, CASE WHEN event_id % 3 > 0 THEN 'F' || (event_id % 5) END AS family, event_id % 4 AS priority FROM events)"


@query(f"WITH {_REQUESTS} SELECT file, rule_id, min(seq) AS seq, string_agg(CAST(line AS VARCHAR), ',' ORDER BY seq) AS lines, arg_min(message, seq) AS message, count(*) AS n FROM r GROUP BY 1, 2")
def merge_by_rule(spark, sf_dir):
    return requests.merged_by_rule(_requests(spark, sf_dir)).select("file", "rule_id", "seq", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"), "message", "n")


@query(f"WITH {_REQUESTS} SELECT file, seq, CAST(row_number() OVER (PARTITION BY file ORDER BY family IS NULL, family, priority, seq) AS INT) AS place FROM r")
def family_order(spark, sf_dir):
    return requests.ordered(_requests(spark, sf_dir)).select("file", "seq", "place")


@query(
    f"""WITH {_REQUESTS}, k AS (SELECT *, coalesce('family:' || family, 'rule:' || rule_id || ':' || seq) AS key FROM r),
u AS (SELECT file, key, message, min(seq) AS s FROM k GROUP BY 1, 2, 3), m AS (SELECT file, key, string_agg(message, chr(10) ORDER BY s) AS message FROM u GROUP BY 1, 2)
SELECT k.file, k.key, CAST(min(line) AS INT) AS line, any_value(m.message) AS message, count(*) AS n FROM k JOIN m ON m.file = k.file AND m.key = k.key GROUP BY 1, 2"""
)
def family_consolidate(spark, sf_dir):
    return requests.consolidated(_requests(spark, sf_dir)).select("file", "key", "line", "message", "n")


@query(
    f"""WITH RECURSIVE {_REQUESTS}, o AS (SELECT file, seq, family, row_number() OVER (PARTITION BY file ORDER BY family IS NULL, family, priority, seq) AS place FROM r),
c(file, seq, family, place, chunk, held, seen) AS (
  SELECT file, seq, family, place, 0, 1, CASE WHEN family IS NULL THEN CAST([] AS VARCHAR[]) ELSE [family] END FROM o WHERE place = 1
  UNION ALL
  SELECT file, seq, family, place, CASE WHEN isfull THEN chunk + 1 ELSE chunk END, CASE WHEN isfull THEN 1 ELSE held + 1 END,
    CASE WHEN family IS NULL THEN CASE WHEN isfull THEN CAST([] AS VARCHAR[]) ELSE seen END WHEN isfull THEN [family] WHEN list_contains(seen, family) THEN seen ELSE list_append(seen, family) END
  FROM (SELECT o.*, c.chunk, c.held, c.seen, CASE WHEN o.family IS NULL THEN c.held >= 8 ELSE NOT list_contains(c.seen, o.family) AND (len(c.seen) >= 2 OR c.held >= 8) END AS isfull FROM c JOIN o ON o.file = c.file AND o.place = c.place + 1))
SELECT file, seq, family, CAST(place AS INT) AS place, CAST(chunk AS INT) AS chunk FROM c"""
)
def request_chunks(spark, sf_dir):
    return requests.chunks(requests.ordered(_requests(spark, sf_dir)).select("file", "seq", "family", "place"))


@query("WITH x AS (SELECT doc_id, lang || '.test' AS f FROM documents UNION ALL SELECT doc_id, source || '.test' FROM documents) SELECT f AS file, 'test-fix:' || arg_min('d' || doc_id, doc_id) AS rule_id, 1 AS line FROM x GROUP BY 1")
def test_requests(spark, sf_dir):
    tests = F.array(F.concat("lang", F.lit(".test")), F.concat("source", F.lit(".test")))
    rows = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("rule_id"), F.col("doc_id").alias("seq"), tests.alias("companion_tests"))
    return requests.test_requests(rows).select("file", "rule_id", "line")


@query("SELECT conv_id, arg_max(text, turn) AS text FROM conversations WHERE role = 'assistant' AND trim(text) <> '' GROUP BY conv_id")
def last_answer(spark, sf_dir):
    return requests.last_answer(_table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN md5('## Summary ' || text) WHEN 1 THEN md5('## Changes Applied ' || text) END AS h FROM conversations WHERE text <> ''")
def section_extract(spark, sf_dir):
    text = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("# A\n## Summary "), "text", F.lit("\n## End\nx"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("## Summary no\n## Changes Applied "), "text")).otherwise(F.concat(F.lit("# A "), "text"))
    return _table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", F.md5(tx.section(text).cast("binary")).alias("h"))


_EDGES = "e AS (SELECT DISTINCT CAST(user_id % 150 AS VARCHAR) AS child, props ->> 'k' AS parent FROM events WHERE event_type = 'purchase' AND value < 4)"


def _graph(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").where("event_type = 'purchase' and value < 4")
    return rows.select((F.col("user_id") % 150).cast("string").alias("child"), F.get_json_object("props", "$.k").alias("parent"))


@query(
    f"""WITH RECURSIVE {_EDGES}, r(node) AS (SELECT parent FROM e WHERE child = '1' AND parent <> '1' UNION SELECT e.parent FROM r JOIN e ON e.child = r.node WHERE e.parent <> '1' AND e.parent <> e.child) SELECT node FROM r"""
)
def closure(spark, sf_dir):
    return graph.ancestors(_graph(spark, sf_dir), "1").select("node")


@query(f"WITH {_EDGES} SELECT DISTINCT parent AS node FROM e WHERE child = '1' AND parent <> '1'")
def direct_dependents(spark, sf_dir):
    return graph.dependents(_graph(spark, sf_dir), "1")


def _whole_graph(spark, sf_dir):
    """All pairs of part and supplier of the line items, from part to supplier and from supplier to the next part."""
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("p"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("s"), F.concat(F.lit("p"), (F.col("l_partkey") + 1).cast("string")).alias("q"))
    return rows.select(F.col("p").alias("child"), F.col("s").alias("parent")).unionByName(rows.select(F.col("s").alias("child"), F.col("q").alias("parent")))


@query(None)
def closure_whole(spark, sf_dir):
    return graph.ancestors(_whole_graph(spark, sf_dir), "p1")


@query("SELECT DISTINCT 's' || l_suppkey AS node FROM lineitem WHERE l_partkey = 1")
def direct_dependents_whole(spark, sf_dir):
    return graph.dependents(_whole_graph(spark, sf_dir), "p1")


@query("WITH m AS (SELECT (min(event_id) + max(event_id)) / 2 AS h FROM events) SELECT DISTINCT user_id, props FROM events, m WHERE event_id > h EXCEPT SELECT user_id, props FROM events, m WHERE event_id <= h")
def new_against_baseline(spark, sf_dir):
    rows = _table(spark, sf_dir, "events")
    half = rows.agg(((F.min("event_id") + F.max("event_id")) / 2).alias("h"))
    rows = rows.crossJoin(F.broadcast(half))
    pair = ["user_id", "props"]
    return rows.where("event_id > h").select(*pair).distinct().join(rows.where("event_id <= h").select(*pair), pair, "left_anti")


_VERSION = "CAST(p_size AS VARCHAR) || '.' || (p_partkey % 20) || '.' || (p_partkey % 7) || CASE WHEN p_partkey % 11 = 0 THEN '-beta.1' ELSE '' END"


@query(
    f"""WITH v AS (SELECT p_brand, {_VERSION} AS v, p_size AS a, p_partkey % 20 AS b, p_partkey % 7 AS c FROM part)
SELECT p_brand, '^' || arg_max(v, [a, b, c]) AS latest FROM v WHERE NOT contains(v, 'beta') AND a >= 10 GROUP BY 1"""
)
def latest_version(spark, sf_dir):
    version = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 20).cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.when(F.col("p_partkey") % 11 == 0, "-beta.1").otherwise(""))
    rows = _table(spark, sf_dir, "part").select("p_brand", version.alias("version")).where(vs.is_release(F.col("version")) & (vs.major(F.col("version")) >= 10))
    return rows.groupBy("p_brand").agg(F.concat(F.lit("^"), F.max_by("version", F.struct(vs.parts(F.col("version")).alias("p"), "version"))).alias("latest"))


@query(
    """SELECT p_partkey, [p_size, p_partkey % 20, p_partkey % 7] >= [10, 5, p_partkey % 3] AS at_least, [p_size, p_partkey % 20, p_partkey % 7] >= [20, 3, 1] AND p_size = 20 AS within FROM part"""
)
def range_compatible(spark, sf_dir):
    part = _dealt(_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    low = F.concat(F.lit(">=10.5."), (F.col("p_partkey") % 3).cast("string"))
    return part.select("p_partkey", vs.range_allows(low, F.concat(F.lit("^"), version)).alias("at_least"), vs.range_allows(F.lit("^20.3.1"), version).alias("within"))


@query(
    """SELECT s_suppkey AS file, 6 AS line, md5('    "p2": "^9.9.9"') AS h FROM supplier WHERE s_suppkey % 9 <> 4"""
)
def manifest_update(spark, sf_dir):
    n = (F.col("s_suppkey") % 9).cast("string")
    v = F.when(n == "4", "^9.9.9").otherwise(F.concat(F.lit("^"), n, F.lit(".0.0")))
    text = F.concat(F.lit('{\n  "name": "'), "s_name", F.lit('",\n  "p2": "no",\n  "dependencies": {\n    "p1": "1.0.0",\n    "p2": "'), v, F.lit('"\n  },\n  "devDependencies": {\n    "p2": "1"\n  }\n}\n'))
    lines = readers.source_lines(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), text.alias("text")))
    wanted = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("file"), F.lit("p2").alias("package"), F.lit("^9.9.9").alias("version"))
    return planning.manifest_changes(wanted, lines).where("reason is null").select("file", "line", F.md5(F.col("new_text").cast("binary")).alias("h"))


def _locks(spark, sf_dir, entry):
    """(file, parts) of orders: an entry for each line item, which is built where its order has met."""
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", *[F.col(c).cast("string").alias(c) for c in ("l_partkey", "l_suppkey")])))
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(items.alias("items"))
    return rows.select("file", F.transform("items", lambda x: entry(x["l_partkey"], x["l_suppkey"], x["l_linenumber"].cast("string"))).alias("parts"))


@query("SELECT DISTINCT l_orderkey AS file, '@s/' || l_suppkey AS child, 'p' || l_partkey AS parent FROM lineitem")
def yarn_lock_edges(spark, sf_dir):
    entry = lambda part, supplier, _: F.concat(F.lit('"p'), part, F.lit('@npm:^1.0.0, p@npm:2":\n  version: 1.0.0\n  resolution: "x"\n  dependencies:\n    "@s/'), supplier, F.lit('": "npm:^2"\n  bin:\n    tool: y\n'))
    texts = _locks(spark, sf_dir, entry).select("file", F.concat(F.lit("# lock\n__metadata:\n  version: 8\n\n"), F.array_join("parts", "\n")).alias("text"))
    return readers.yarn_text_edges(texts)


@query("SELECT DISTINCT l_orderkey AS file, 's' || l_suppkey AS child, '@p/' || l_partkey AS parent FROM lineitem")
def npm_lock_edges(spark, sf_dir):
    entry = lambda part, supplier, number: F.concat(F.lit('"node_modules/a/node_modules/@p/'), part, F.lit('#'), number, F.lit('": {"version": "1.0.0", "peerDependencies": {"s'), supplier, F.lit('": "^1"}}'))
    texts = _locks(spark, sf_dir, entry).select("file", F.concat(F.lit('{"packages": {"": {"dependencies": {"root": "1"}}, '), F.array_join("parts", ", "), F.lit("}}")).alias("text"))
    return readers.npm_edges(texts).select("file", "child", F.regexp_replace("parent", "#.*", "").alias("parent")).distinct()


@query("SELECT DISTINCT l_orderkey AS file, 's' || l_suppkey AS child, '@p/' || l_partkey AS parent FROM lineitem")
def pnpm_lock_edges(spark, sf_dir):
    entry = lambda part, supplier, number: F.concat(F.lit("  '@p/"), part, F.lit("@1.0.0(x@"), number, F.lit(")':\n    resolution: {integrity: x}\n    dependencies:\n      s"), supplier, F.lit(": 1.0.0\n    engines:\n      node: '>=8'\n"))
    texts = _locks(spark, sf_dir, entry).select("file", F.concat(F.lit("lockfileVersion: '9.0'\n\nsnapshots:\n\n"), F.array_join("parts", "\n")).alias("text"))
    return readers.pnpm_text_edges(texts)


@query("SELECT 'b' || replace(p_brand, ' ', '_') AS peer, arg_min('r' || p_partkey, p_partkey) AS requested_by FROM part GROUP BY 1")
def missing_peers(spark, sf_dir):
    text = F.concat(F.lit("\x1b[93m"), F.lit("YN0002: │ app@workspace:. \x1b[0mdoesn't provide b"), F.translate("p_brand", " ", "_"), F.lit(" (p123), requested by r"), F.col("p_partkey").cast("string"), F.lit("."))
    return requests.missing_peers(_dealt(_table(spark, sf_dir, "part").select("p_partkey", "p_brand")).select(F.lit("log").alias("file"), F.col("p_partkey").alias("line"), text.alias("text")))


@query(
    """WITH t AS (SELECT conv_id, turn, conv_id * 1000 + turn AS file FROM conversations)
SELECT file, 1 AS block, CAST(turn + 1 AS INT) AS at_line, 'old ' || conv_id AS old_text, 'new ' || turn AS new_text FROM t UNION ALL SELECT file, 2, 7, 'x', '' FROM t"""
)
def fix_block_parse(spark, sf_dir):
    head = F.concat(F.lit("Talk LINE: 3\n```fix\nLINE: "), (F.col("turn") + 1).cast("string"), F.lit("\nOLD: old "), F.col("conv_id").cast("string"), F.lit("  \nNEW: new "), F.col("turn").cast("string"))
    text = F.concat(head, F.lit("\nOLD: lost\nNEW: no number\n```\n```js\nLINE: 1\nOLD: a\nNEW: b\n```\n```fix\nLINE: 7\nOLD: x\nNEW:\n```\n"))
    rows = _table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("file"), text.alias("text"))
    found = requests.fix_blocks(readers.source_lines(rows))
    return found.select("file", F.when(F.col("block") == 1, 1).otherwise(2).alias("block"), "at_line", "old_text", "new_text")


@query(
    """SELECT p_partkey AS file, 1 AS line, 'import org.neu.Fresh;' AS new_text FROM part UNION ALL SELECT p_partkey, 3, 'new Fresh(' || p_size || ') Olden' FROM part"""
)
def java_rename(spark, sf_dir):
    text = F.concat(F.lit("import org.alt.Old;\nclass Olden {}\nnew Old("), F.col("p_size").cast("string"), F.lit(") Olden\n"))
    lines = readers.source_lines(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), text.alias("text")))
    incidents = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), F.col("p_partkey").alias("file"), F.lit("org.alt.Old").alias("old_name"), F.lit("org.neu.Fresh").alias("new_name"))
    return planning.java_renames(incidents, lines).select("file", "line", "new_text")


@query("SELECT p_partkey AS file, 1 AS line, 'public ' || p_name AS new_text FROM part WHERE p_partkey % 2 = 0")
def annotation_removal(spark, sf_dir):
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, '  @Old(since = "1") public ').otherwise("  @Older public "), "p_name")
    return planning.annotation_edits(readers.source_lines(_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), text.alias("text"))), "Old").select("file", "line", "new_text")


@query(
    """WITH u AS (SELECT l_orderkey AS file, '"p' || (l_partkey % 5) || '": "1"' AS t, min(l_linenumber) AS i FROM lineitem GROUP BY 1, 2)
SELECT file, 1 AS line, string_agg(t, ',' || chr(10) ORDER BY i, t) AS new_text FROM u GROUP BY 1"""
)
def insert_merge(spark, sf_dir):
    new = F.concat(F.lit('"p'), (F.col("l_partkey") % 5).cast("string"), F.lit('": "1"'))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.lit(1).alias("line"), F.col("l_linenumber").cast("long").alias("seq"), F.lit("}").alias("old_text"), new.alias("new_text"), F.lit("r").alias("rule_id"))
    return ed.merged_inserts(rows).select("file", "line", "new_text")


@query(f"WITH {LINES} SELECT lang, count(*) AS changed_lines FROM lines JOIN documents ON doc_id = file WHERE contains(text, 'the') OR contains(text, 'tion') GROUP BY lang".replace("contains(text", "contains(lines.text"))
def rename_run(spark, sf_dir):
    """Lines, edits, settle, apply, count; the plan_ queries run plan() itself."""
    lines = _lines(spark, sf_dir)
    changed = ed.changed_lines(ed.settled(_edits(spark, sf_dir)), lines)
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "lang")
    return changed.join(docs, "file").groupBy("lang").agg(F.count("*").alias("changed_lines"))


@query("SELECT doc_id, 'file:///data/docs/' || lang || '/' || doc_id AS uri, '/data/docs/' || lang || '/' || doc_id AS path FROM documents")
def uri_round_trip(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", tx.file_uri(F.concat(F.lit(" docs/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")), "/data").alias("uri"))
    return rows.select("doc_id", "uri", tx.path_of_uri(F.col("uri"), "/").alias("path"))


@query("SELECT DISTINCT 'docs/' || doc_id AS file_uri FROM labels WHERE toxic = 1")
def file_list(spark, sf_dir):
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    rows = _table(spark, sf_dir, "labels")
    plain = rows.where("toxic = 1").select(F.concat(F.lit("# list\n\n  "), name, F.lit(" \n")).alias("text"))
    retry = rows.where("toxic = 1").select(F.concat(F.lit('{"timed_out": [{"file": "'), name, F.lit('"}], "failed": []}')).alias("text"))
    return readers.file_filter(plain.unionByName(retry))


@query(
    """SELECT CAST(l_orderkey AS VARCHAR) AS ruleset, 'rule-' || l_linenumber AS rule_id, 'file:///p/' || l_partkey AS file_uri, l_suppkey AS line, 'ship ' || l_returnflag AS message FROM lineitem"""
)
def report_incidents(spark, sf_dir):
    incident = F.struct(F.concat(F.lit("file:///p/"), F.col("l_partkey").cast("string")).alias("uri"), F.col("l_suppkey").alias("lineNumber"), F.concat(F.lit("ship "), "l_returnflag").alias("message"))
    rules = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.concat(F.lit("rule-"), F.col("l_linenumber").cast("string")).alias("rule")).agg(F.struct(F.array(F.lit("l")).alias("labels"), F.collect_list(incident).alias("incidents")).alias("v"))
    sets = rules.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("rule", "v"))).alias("violations"))
    text = F.to_json(F.array(F.struct(F.col("l_orderkey").cast("string").alias("name"), "violations")))
    return readers.findings(sets.select(text.alias("text"))).select("ruleset", "rule_id", "file_uri", F.col("line").cast("long").alias("line"), "message")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'c' || event_id WHEN event_id % 3 = 1 THEN 'p' || event_id ELSE '' END AS matched FROM events")
def matched_variable(spark, sf_dir):
    n = F.col("event_id").cast("string")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"propName": 7, "componentName": "c'), n, F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"className": "x", "propName": "p'), n, F.lit('"}'))).otherwise(F.lit('{"other": "x"}'))
    rows = _table(spark, sf_dir, "events").select("event_id", F.from_json(text, "map<string,variant>").alias("variables"))
    return rows.select("event_id", pl.matched_text().alias("matched"))


@query("SELECT user_id, event_type, 'k: ' || (props ->> 'k') || chr(10) || 'name: ' || event_type AS context FROM events")
def incident_variables_text(spark, sf_dir):
    text = F.concat(F.lit('{"name": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    rows = _table(spark, sf_dir, "events").select("user_id", "event_type", F.from_json(text, "map<string,variant>").alias("variables"))
    return rows.select("user_id", "event_type", pl.incident_context().alias("context"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dropped' WHEN 1 THEN 'pending' WHEN 2 THEN 'pending' ELSE 'manifest' END AS route FROM part")
def dependency_routing(spark, sf_dir):
    ending = F.get(F.array(*[F.lit(x) for x in (".java", ".tsx", ".js", "/package.json")]), (F.col("p_partkey") % 4).cast("int"))
    return pl.routed_dependencies(_table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("/a/"), F.translate("p_name", " ", "_"), ending).alias("file"))).select("p_partkey", "route")


@query(
    """WITH t AS (SELECT DISTINCT p_size % 25 AS folder, p_partkey % 2 = 0 AS inner_folder, p_partkey % 40 AS n FROM part),
s AS (SELECT s_nationkey, s_suppkey FROM supplier)
SELECT '/f' || s_nationkey || '/s' || s_suppkey || '.ts' AS file, coalesce(string_agg(CASE WHEN n IS NOT NULL THEN '/f' || folder || CASE WHEN inner_folder THEN '/__tests__/' ELSE '/' END || 'S' || n || '.test.ts' END, ','
  ORDER BY '/f' || folder || CASE WHEN inner_folder THEN '/__tests__/' ELSE '/' END || 'S' || n || '.test.ts'), '') AS tests
FROM s LEFT JOIN t ON folder = s_nationkey AND starts_with('s' || n || '.test.ts', 's' || s_suppkey) GROUP BY s_nationkey, s_suppkey"""
)
def companion_tests(spark, sf_dir):
    name = F.concat(F.lit("S"), (F.col("p_partkey") % 40).cast("string"), F.lit(".test.ts"))
    folder = F.concat(F.lit("/f"), (F.col("p_size") % 25).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "/__tests__/").otherwise("/"))
    listing = _table(spark, sf_dir, "part").select(F.concat(folder, name).alias("path")).distinct()
    sources = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("/f"), F.col("s_nationkey").cast("string"), F.lit("/s"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("file"))
    return pl.companion_tests(sources, listing).select("file", F.array_join("companion_tests", ",").alias("tests"))


@query("SELECT DISTINCT '/m/' || s_nationkey || '/x/y/' || s_suppkey || '.ts' AS path, CASE WHEN s_nationkey % 2 = 0 THEN '/m/' || s_nationkey || '/x/package.json' ELSE '/m/package.json' END AS manifest FROM supplier")
def nearest_manifests(spark, sf_dir):
    n = F.col("n_nationkey").cast("string")
    manifests = _table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.explode(F.array(F.concat(F.lit("/m/"), n, F.lit("/x/package.json")), F.lit("/m/package.json"))).alias("file")).distinct()
    paths = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("/m/"), F.col("s_nationkey").cast("string"), F.lit("/x/y/"), F.col("s_suppkey").cast("string"), F.lit(".ts")).alias("path")).distinct()
    return readers.nearest_manifest(paths, manifests)


@query(
    """SELECT s_suppkey AS file, 'dependencies' AS section, 'p' || s_nationkey AS name, '^' || (s_suppkey % 9) || '.0.0' AS version FROM supplier UNION ALL SELECT s_suppkey, 'peerDependencies', 'q', '*' FROM supplier"""
)
def manifest_dependencies(spark, sf_dir):
    text = F.concat(F.lit('{"name": "x", "dependencies": {"p'), F.col("s_nationkey").cast("string"), F.lit('": "^'), (F.col("s_suppkey") % 9).cast("string"), F.lit('.0.0"}, "peerDependencies": {"q": "*"}}'))
    return readers.manifest_dependencies(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), text.alias("text")))


@query(
    """WITH r AS (SELECT p_brand, p_size AS a, p_partkey % 20 AS b, p_partkey % 7 AS c, p_partkey % 5 AS d FROM part)
SELECT p_brand AS package, '^' || arg_max(a || '.' || b || '.' || c, [a, b, c]) AS latest FROM r WHERE d = 0 OR d + 2 >= 5 GROUP BY 1"""
)
def registry_latest(spark, sf_dir):
    d = F.col("p_partkey") % 5
    version = F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 20).cast("string"), (F.col("p_partkey") % 7).cast("string"))
    need = F.when(d != 0, F.create_map(F.lit("core"), F.concat(F.lit("^"), (d + 2).cast("string"), F.lit(".0.0"))))
    registry = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("package"), version.alias("version"), F.when(d > 2, need).alias("dependencies"), F.when(d <= 2, need).alias("peerDependencies"))
    wanted = registry.select("package").distinct().select("package", F.lit("core").alias("dependency"), F.lit(5).alias("major"))
    return pl.latest_compatible(registry, wanted).select("package", "latest")


@query(f"WITH {LINES}, a AS (SELECT file, line, replace(replace(text, 'tion', 'TION'), 'the', 'THE') AS t FROM lines) SELECT file, md5(string_agg(t, chr(10) ORDER BY line)) AS h FROM a GROUP BY file")
def rebuilt_files(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    edits = ed.settled(_edits(spark, sf_dir).where("replace_all"))
    return ed.rebuilt_files(ed.apply_edits(edits, lines)).select("file", F.md5(F.col("text").cast("binary")).alias("h"))


@query(
    """WITH f AS (SELECT user_id, event_type, event_type = 'error' AS late FROM events WHERE event_type IN ('error', 'click') AND value > 20)
SELECT late AS timed_out, 'u' || user_id AS file, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS rule_ids FROM f GROUP BY 1, 2"""
)
def retry_entries(spark, sf_dir):
    bad = F.col("event_type").isin("error", "click") & (F.col("value") > 20)
    results = _table(spark, sf_dir, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("rule_id"), (~bad).alias("ok"), (F.col("event_type") == "error").alias("timed_out"), F.lit(None).cast("string").alias("error"))
    text = "struct<timed_out:array<struct<file:string,rule_ids:array<string>>>,failed:array<struct<file:string,rule_ids:array<string>>>>"
    read = pl.retry_list(results).select(F.from_json("text", text).alias("r")).select(F.col("r.timed_out").isNotNull().alias("timed_out"), F.coalesce("r.timed_out", "r.failed")[0].alias("x"))
    return read.select("timed_out", "x.file", F.array_join("x.rule_ids", ",").alias("rule_ids"))


@query(
    f"""WITH {_REQUESTS}, o AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY family IS NULL, family, priority, seq) AS place FROM r)
SELECT file, md5('Change the file ' || file || ' as asked for below. Change nothing else.' || chr(10) || string_agg('- line ' || line || ': [' || rule_id || '] ' || message, chr(10) ORDER BY place)) AS h FROM o GROUP BY file"""
)
def prompt_text(spark, sf_dir):
    rows = requests.ordered(_requests(spark, sf_dir).withColumn("file", F.col("file").cast("string"))).withColumn("chunk", F.lit(0))
    return requests.prompts(rows).select(F.col("file").cast("long").alias("file"), F.md5(F.col("prompt").cast("binary")).alias("h"))


@query(
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS family, doc_id % 5 = 0 AND doc_id % 2 = 1 AS test_only FROM documents"""
)
def label_predicates(spark, sf_dir):
    labels = F.filter(F.array(F.when(F.col("doc_id") % 2 == 0, "change-type=other"), F.when(F.col("doc_id") % 5 == 0, "change-type=test-impact"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("family="), "lang")), F.lit("family=zz")), lambda x: x.isNotNull())
    rows = _table(spark, sf_dir, "documents").select("doc_id", labels.alias("labels"))
    family = planning.family(F.col("labels"))
    return rows.select("doc_id", F.when(family != "zz", family).alias("family"), planning.test_impact_only(F.col("labels")).alias("test_only"))


@query(
    """SELECT DISTINCT l_orderkey AS file, l_linenumber AS line, 'part.' || l_returnflag || '.a.b' AS old_text FROM lineitem WHERE l_returnflag <> 'N'"""
)
def config_renames(spark, sf_dir):
    flags = _table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().where("l_returnflag <> 'N'")
    old = F.concat(F.lit("part."), "l_returnflag", F.lit(".a.b"))
    strategies = flags.select(old.alias("rule_id"), F.lit("JavaImportRename").alias("kind"), F.struct(old.alias("from"), F.lit("x.y.Z").alias("to")).alias("entry"))
    text = F.concat(F.lit("<bean class='part."), "l_returnflag", F.lit(".a.b.Inner'/> part.x"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), text.alias("text"))
    found = pl.config_renames(strategies, lines.withColumn("file", F.concat(F.col("file").cast("string"), F.lit(".xml"))))
    return found.select(F.regexp_replace("file", ".xml", "").cast("long").alias("file"), "line", "old_text")


@query(
    """SELECT s_suppkey AS file, 2 AS line, '  "new": "^2"' AS new_text FROM supplier WHERE s_suppkey % 2 = 0"""
)
def proactive_dependencies(spark, sf_dir):
    entry = F.struct(F.lit("new").alias("package"), F.lit("^2").alias("new_version"), F.lit("old").alias("old_package"))
    known = _table(spark, sf_dir, "region").select("r_name").agg(F.max("r_name")).select(F.lit("dep").alias("rule_id"), F.lit("EnsureDependency").alias("kind"), entry.alias("entry"))
    text = F.concat(F.lit('{\n  "'), F.when(F.col("s_suppkey") % 2 == 0, "old").otherwise("older"), F.lit('": "1"\n}'))
    lines = readers.source_lines(_table(spark, sf_dir, "supplier").select(F.concat(F.col("s_suppkey").cast("string"), F.lit("/package.json")).alias("file"), text.alias("text")))
    incidents = _table(spark, sf_dir, "events").select(F.col("event_type").alias("rule_id"))
    return pl.proactive_dependencies(known, incidents, lines).select(F.regexp_replace("file", "/.*", "").cast("long").alias("file"), "line", "new_text")


@query(
    """SELECT s_suppkey AS file, CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 3 END AS line, CASE WHEN s_suppkey % 2 = 0 THEN '    "d": "1",' ELSE '    "p1": "1.0.0",' END || chr(10) || '    "new": "^3"' AS new_text FROM supplier"""
)
def manifest_insert(spark, sf_dir):
    dev = F.when(F.col("s_suppkey") % 2 == 0, ',\n  "devDependencies": {\n    "d": "1"\n  }').otherwise("")
    text = F.concat(F.lit('{\n  "dependencies": {\n    "p1": "1.0.0"\n  }'), dev, F.lit("\n}\n"))
    lines = readers.source_lines(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), text.alias("text")))
    wanted = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("seq"), F.col("s_suppkey").alias("file"), F.lit("new").alias("package"), F.lit("^3").alias("version"))
    return planning.manifest_changes(wanted, lines).where("reason is null").select("file", "line", "new_text")


@query(
    """SELECT 'q' || p_size AS peer, 'Pkg' || p_partkey AS requested_by, CASE WHEN p_size < 25 THEN '^' || p_size || '.0.0' END AS "range" FROM part"""
)
def peer_ranges(spark, sf_dir):
    size, key = F.col("p_size").cast("string"), F.concat(F.lit("Pkg"), F.col("p_partkey").cast("string"))
    part = _table(spark, sf_dir, "part")
    text = F.concat(F.lit('{"peerDependencies": {"q'), F.when(F.col("p_size") < 25, size).otherwise("x"), F.lit('": "^'), size, F.lit('.0.0"}, "dependencies": {"q'), size, F.lit('": "no"}}'))
    manifests = readers.manifest_dependencies(part.select(key.alias("file"), text.alias("text")))
    return planning.peer_ranges(part.select(F.concat(F.lit("q"), size).alias("peer"), key.alias("requested_by")), manifests)


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'a repair' WHEN 'click' THEN 'a rename' ELSE 'a code migration' END AS description, CASE event_type WHEN 'error' THEN 1 ELSE 3 END AS priority FROM events")
def request_context(spark, sf_dir):
    table = context_table(spark, (Context("error", "x"), Context("error", "a repair", priority=1), Context("click", "a rename")))
    rows = with_context(_table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("ruleset")), table)
    return rows.select("event_id", "description", "priority")


@query(
    """WITH f AS (SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(n_name || ' -> c' || n_nationkey, ', ' ORDER BY n_name) AS moves FROM nation GROUP BY 1)
SELECT s_suppkey, CASE WHEN s_nationkey < 3 THEN 'Props that stay: ' || names || chr(10) || 'Props that move to children: ' || moves || chr(10) || 'New imports: ' || r_name || ' from x' || chr(10) || chr(10) ELSE '' END || 'm' || s_suppkey AS message
FROM supplier LEFT JOIN f ON n_regionkey = s_nationkey LEFT JOIN region ON r_regionkey = s_nationkey"""
)
def family_text(spark, sf_dir):
    nations = _table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"), F.map_from_entries(F.collect_list(F.struct("n_name", F.concat(F.lit("c"), F.col("n_nationkey").cast("string"))))).alias("moves"))
    none, texts, pairs = F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit(None).cast("map<string,string>")
    entry = F.struct(
        none.alias("target_structure"), F.col("names").alias("retained_props"), F.col("moves").alias("prop_to_child"), pairs.alias("unmapped_removed_props"), pairs.alias("child_props_to_parent"),
        texts.alias("removed_children"), F.array("r_name").alias("new_imports"), F.lit("x").alias("import_source"), texts.alias("removed_imports"),
    )
    families = nations.join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_regionkey < 3").select(F.concat(F.lit("family:F"), F.col("n_regionkey").cast("string")).alias("rule_id"), entry.alias("entry"))
    asked = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("F"), F.col("s_nationkey").cast("string")).alias("family"), F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("message"))
    return pl.with_family(asked, families).select("s_suppkey", "message")


#: Strategies of the reports below; rules without an entry go by their labels, else to a model.
_PLAN_RULES = {
    "all": {"strategy": "Rename", "mappings": [{"from": "the", "to": "THE"}, {"from": "same", "to": "same"}]}, "near": {"strategy": "Rename", "from": "tion", "to": "TION"},
    "css": {"strategy": "CssVariablePrefix", "from": "of", "to": "OF", "exclude_patterns": ["de"]}, "talk": {"strategy": "LlmAssisted", "component": "C"},
}


def _plan(spark, sf_dir):
    """The plan of reports with an incident or two for every document: by doc_id modulo 5 a rename all over the file, one near a line, an attribute, a style prefix, or a request."""
    docs = _table(spark, sf_dir, "documents")
    k, number, tests = F.col("doc_id") % 5, F.col("doc_id").cast("string"), F.col("doc_id") % 10 == 9
    one = lambda rule, line, label, names, when: F.when(when, F.struct(F.lit(rule).alias("rule"), F.lit(line).alias("line"), F.lit(label).alias("label"), names.alias("variables")))
    named = lambda name, value: F.map_from_arrays(F.array(F.lit(name)), F.array(value))
    found = F.array(
        one("all", 1, "", named("importedName", F.lit("the")), k == 0), one("near", 2, "", named("propName", F.lit("zz")), k == 1), one("prop", 1, "change-type=prop-removal", named("propName", F.lit("zzz")), k == 2),
        one("css", 1, "", named("className", F.col("lang")), k == 3), one("dead", 1, "change-type=css-dead-class", named("className", F.col("lang")), (k == 3) & (F.col("lang") == "fr")),
        one("talk", 3, "", named("propName", F.lit("q")), (k == 4) & ~tests), one("tests", 3, "change-type=test-impact", named("propName", F.lit("q")), (k == 4) & tests),
    )
    rows = docs.select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i"))
    incident = F.struct(F.concat(F.lit("file:///r/"), number, F.lit(".tsx")).alias("uri"), F.col("i.line").alias("lineNumber"), F.concat(F.lit("ask "), number).alias("message"), F.col("i.variables").alias("variables"))
    rules = rows.groupBy((F.col("doc_id") % 64).alias("report"), F.col("i.rule").alias("rule")).agg(F.struct(F.array(F.max("i.label")).alias("labels"), F.collect_list(incident).alias("incidents")).alias("v"))
    sets = rules.groupBy("report").agg(F.to_json(F.array(F.struct(F.lit("s").alias("name"), F.map_from_entries(F.collect_list(F.struct("rule", "v"))).alias("violations")))).alias("text"))
    strategies = readers.strategies(spark.createDataFrame([(0, json.dumps(_PLAN_RULES))], "file_ix int, text string"))
    lines = _lines(spark, sf_dir).withColumn("file", F.concat(F.lit("/r/"), F.col("file").cast("string"), F.lit(".tsx")))
    return pl.plan(readers.findings(sets.select(F.col("report").alias("file"), "text")), strategies, lines, "/r")


_PLANNED = f"""{LINES}, d AS (SELECT doc_id, lang, doc_id % 5 AS k, doc_id % 10 = 9 AS tests, '/r/' || doc_id || '.tsx' AS name FROM documents),
edited AS (SELECT name, doc_id, line, CASE k WHEN 0 THEN 'the' WHEN 1 THEN 'tion' ELSE 'of' END AS old_text FROM lines JOIN d ON doc_id = file
  WHERE (k = 0 AND contains(text, 'the')) OR (k = 1 AND line <= 6 AND contains(text, 'tion')) OR (k = 3 AND lang NOT IN ('de', 'fr') AND line <= 5 AND contains(text, 'of'))),
by_hand AS (SELECT name, CASE k WHEN 3 THEN 'css' ELSE 'tests' END AS rule_id, CASE k WHEN 3 THEN 1 ELSE 3 END AS line, CASE WHEN k = 4 THEN 'Only tests are touched, and there are none. ' WHEN lang = 'de' THEN 'Class de was removed. ' ELSE 'Class fr does not exist any more. ' END || 'ask ' || doc_id AS message
  FROM d WHERE (k = 3 AND lang IN ('de', 'fr')) OR (k = 4 AND tests)),
asked AS (SELECT name, CASE k WHEN 3 THEN 'dead' ELSE 'talk' END AS rule_id, CASE k WHEN 3 THEN 1 ELSE 3 END AS line, 'ask ' || doc_id || chr(10) || chr(10) || 'Incident:' || chr(10) ||
  CASE k WHEN 3 THEN 'className: fr' ELSE 'propName: q' || chr(10) || chr(10) || 'Strategy:' || chr(10) || 'Strategy: LlmAssisted' || chr(10) || 'Component: C' END AS message FROM d WHERE (k = 3 AND lang = 'fr') OR (k = 4 AND NOT tests)),
missed AS (SELECT name, CASE k WHEN 0 THEN 'all' WHEN 1 THEN 'near' WHEN 2 THEN 'prop' ELSE 'css' END AS rule_id, CASE WHEN k = 2 AND doc_id NOT IN (SELECT file FROM lines) THEN 'line_out_of_bounds' ELSE 'text_not_found' END AS reason
  FROM d WHERE k < 4 AND NOT (k = 3 AND lang IN ('de', 'fr')) AND doc_id NOT IN (SELECT doc_id FROM edited))"""


@query(f"WITH {_PLANNED} SELECT name AS file, CAST(line AS INT) AS line, old_text, upper(old_text) AS new_text FROM edited")
def plan_edits(spark, sf_dir):
    return _plan(spark, sf_dir).edits.select("file", "line", "old_text", "new_text")


@query(f"WITH {_PLANNED} SELECT name AS file, rule_id, line, message FROM by_hand")
def plan_manual(spark, sf_dir):
    return _plan(spark, sf_dir).manual.select("file", "rule_id", "line", "message")


@query(f"WITH {_PLANNED} SELECT name AS file, rule_id, line, message FROM asked")
def plan_pending(spark, sf_dir):
    return _plan(spark, sf_dir).pending.select("file", "rule_id", "line", "message")


@query(f"WITH {_PLANNED} SELECT name AS file, rule_id, reason FROM missed")
def plan_skipped(spark, sf_dir):
    return _plan(spark, sf_dir).skipped.select("file", "rule_id", "reason")


@query(f"WITH {_PLANNED} SELECT count(*) AS pattern_edits, count(DISTINCT name) AS pattern_fixes, count(DISTINCT name) AS files_with_fixes, 0 AS edits_subsumed, (SELECT count(*) FROM by_hand) AS manual_review, (SELECT count(*) FROM asked) AS pending, (SELECT count(*) FROM missed) AS skipped FROM edited")
def plan_summary(spark, sf_dir):
    return pl.summary(_plan(spark, sf_dir)).drop("json")


def _reports(spark, sf_dir):
    """A report for each order: its lines are incidents of a rule for each return flag, and failed runs of rules are errors."""
    items = _table(spark, sf_dir, "lineitem")
    rules = items.groupBy("l_orderkey", "l_returnflag").agg(F.struct(F.collect_list(F.struct(F.lit("f").alias("uri"), F.col("l_linenumber").alias("lineNumber"))).alias("incidents")).alias("v"))
    sets = rules.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "v"))).alias("violations"))
    orders = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "P", F.map_from_arrays(F.array(F.lit("r1")), F.array(F.concat(F.lit("no "), "o_orderpriority")))).alias("errors"))
    return sets.join(orders, "l_orderkey").select(F.col("l_orderkey").alias("file"), F.to_json(F.array(F.struct(F.col("l_orderkey").cast("string").alias("name"), "violations", "errors"))).alias("text"))


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem)) AS violations, (SELECT count(*) FROM lineitem) AS incidents, (SELECT count(DISTINCT o_orderkey) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P') AS errors")
def report_totals(spark, sf_dir):
    return readers.report_totals(_reports(spark, sf_dir))


@query("SELECT 'no ' || o_orderpriority AS message, count(*) AS n, min(CAST(o_orderkey AS VARCHAR)) AS first FROM orders WHERE o_orderstatus = 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def report_errors(spark, sf_dir):
    return readers.report_errors(_reports(spark, sf_dir))


@query("SELECT CASE event_type WHEN 'click' THEN 'real' WHEN 'view' THEN 'informational' WHEN 'purchase' THEN NULL ELSE 'informational' END AS part, count(*) AS n FROM events GROUP BY 1")
def skip_split(spark, sf_dir):
    reason = F.when(F.col("event_type") == "click", "text_not_found").when(F.col("event_type") == "view", "already_migrated").when(F.col("event_type") == "purchase", "no_op_rename").otherwise("version_already_compatible")
    return _table(spark, sf_dir, "events").groupBy(planning.skip_group(reason).alias("part")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS file, 'p' || s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN '1.' || s_suppkey ELSE '2.0' END AS version FROM supplier")
def direct_versions(spark, sf_dir):
    name, key = F.concat(F.lit('"p'), F.col("s_nationkey").cast("string"), F.lit('": "')), F.col("s_suppkey")
    text = F.concat(F.lit('{"devDependencies": {'), name, F.lit('2.0"}, "peerDependencies": {'), name, F.lit('9"}'), F.when(key % 2 == 0, F.concat(F.lit(', "dependencies": {'), name, F.lit("1."), key.cast("string"), F.lit('"}'))).otherwise(""), F.lit("}"))
    return readers.direct_versions(readers.manifest_dependencies(_table(spark, sf_dir, "supplier").select(key.alias("file"), text.alias("text"))))


@query("SELECT p_partkey, p_partkey % 3 = 1 AS locked FROM part")
def lock_file_names(spark, sf_dir):
    key = F.col("p_partkey")
    path = F.concat(F.lit("/a/"), key.cast("string"), F.when(key % 3 == 0, "/yarn.lock.bak").when(key % 6 == 1, "/yarn.lock").when(key % 3 == 1, "/pnpm-lock.yaml").otherwise("/package.json"))
    return _table(spark, sf_dir, "part").select("p_partkey", tx.is_lock_file(path).alias("locked"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'N' || p_size WHEN 1 THEN 'M' || p_size ELSE '' END AS name FROM part")
def annotation_names(spark, sf_dir):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(key % 3 == 0, F.concat(F.lit('{"annotationName": "N'), size, F.lit('", "matchingText": "x"}'))).when(key % 3 == 1, F.concat(F.lit('{"matchingText": "@org.x.M'), size, F.lit('"}'))).otherwise(F.lit('{"typeName": "T"}'))
    return _table(spark, sf_dir, "part").select("p_partkey", F.from_json(text, "map<string,variant>").alias("variables")).select("p_partkey", pl.annotation_name().alias("name"))


_ANSWERED = "a AS (SELECT user_id AS file, event_type = 'click' AS ok, event_type = 'error' AS late FROM events)"


def _answered(spark, sf_dir):
    kind = F.col("event_type")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("chunk"), kind.alias("answer"), (kind == "click").alias("ok"), F.lit(1).alias("tries"), F.when(kind == "error", "timeout: 120").when(kind != "click", "empty answer").alias("error"))


@query(f"WITH {_ANSWERED}, f AS (SELECT file, bool_and(ok) AS ok, bool_or(late) AS late FROM a GROUP BY 1) SELECT count(*) FILTER (ok) AS succeeded, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (late) AS timed_out FROM f")
def answer_counts(spark, sf_dir):
    return requests.answer_counts(_answered(spark, sf_dir))


@query("SELECT user_id AS file, count(*) AS n_chunks, count(*) FILTER (event_type = 'click') AS n_ok, sum(length(event_type)) AS characters, arg_min(event_id, event_id) AS first FROM events GROUP BY 1")
def answer_log(spark, sf_dir):
    read = F.from_json("text", "struct<chunks:array<struct<chunk:long,characters:long>>,n_chunks:long,n_ok:long>")
    rows = requests.answer_log(_answered(spark, sf_dir)).select("file", read.alias("r"))
    return rows.select("file", "r.n_chunks", "r.n_ok", F.aggregate("r.chunks", F.lit(0).cast("long"), lambda a, c: a + c["characters"]).alias("characters"), F.col("r.chunks")[0]["chunk"].alias("first"))


#: Documents whose texts stand one after another in a file of split_lines.
DOCUMENTS_PER_FILE = 1000


@query(
    rf"""WITH files AS (SELECT doc_id // {DOCUMENTS_PER_FILE} AS file, string_agg(text || chr(10), '' ORDER BY doc_id) AS body FROM documents GROUP BY 1),
lines AS (SELECT file, generate_subscripts(ls, 1) AS line, unnest(ls) AS text FROM (SELECT file, string_split_regex(regexp_replace(body, '\r?\n$', ''), '\r?\n') AS ls FROM files))
SELECT CAST(file AS BIGINT) AS file, CAST(line AS INT) AS line, md5(text) AS h FROM lines"""
)
def split_lines(spark, sf_dir):
    """All documents as text files of many splits each, written to the shared folder and read back line by line."""
    texts = _table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / DOCUMENTS_PER_FILE).alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    folder = f"{graph.checkpoint_folder(spark)}/lines-{uuid.uuid4().hex}"
    texts.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(folder)
    session = spark.newSession()  # whose splits are small, so that files of a small table have many too
    session.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    lines = splits.split_lines(session, folder)
    return lines.select(F.regexp_extract("file", r"file=(-?\d+)/", 1).cast("long").alias("file"), "line", F.md5(F.col("text").cast("binary")).alias("h"))


@query(
    f"""WITH {LINES}, olds AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}')) AS old_text FROM conversations), renamed AS (SELECT old_text FROM olds WHERE upper(old_text) <> old_text),
words AS (SELECT DISTINCT file, line, unnest(string_split(text, ' ')) AS w FROM lines), places AS (SELECT w, unnest(range(1, length(w) - 3)) AS i FROM (SELECT w FROM words UNION SELECT old_text FROM renamed)),
pieces AS (SELECT w, i, unnest(range(5, least(length(w) - i + 1, (SELECT max(length(old_text)) FROM renamed)) + 1)) AS n FROM places),
found AS (SELECT DISTINCT w, old_text FROM (SELECT w, substr(w, i, n) AS old_text FROM pieces) JOIN renamed USING (old_text)),
hits AS (SELECT DISTINCT file, line, old_text FROM words JOIN found USING (w))
SELECT file, CAST(line AS INT) AS line, old_text, upper(old_text) AS new_text FROM hits
EXCEPT SELECT file, CAST(line AS INT), f.old_text, upper(f.old_text) FROM hits h JOIN found f ON f.w = h.old_text AND f.old_text <> h.old_text"""
)
def rename_many(spark, sf_dir):
    """Every word of the conversations as a rename, all at once, over all lines of the documents."""
    olds = _table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), F.lit(0))).alias("old_text")).distinct()
    return planning.many_file_edits(_lines(spark, sf_dir), olds.select("old_text", F.upper("old_text").alias("new_text")))


@query(
    """WITH RECURSIVE e AS (SELECT p_partkey AS child, p_partkey + 1 AS parent FROM part UNION SELECT p_partkey, p_partkey + 4 FROM part WHERE p_size = 50),
r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT parent, depth + 1 FROM r JOIN e ON child = node)
SELECT CAST(node AS VARCHAR) AS node, CAST(min(depth) AS INT) AS depth FROM r WHERE node <> 1 GROUP BY node"""
)
def closure_chain(spark, sf_dir):
    """All parts in one chain, each needed by the next, and by one further on where it is of the largest size."""
    part = _table(spark, sf_dir, "part")
    key = lambda ahead: (F.col("p_partkey") + ahead).cast("string")
    edges = part.select(key(0).alias("child"), key(1).alias("parent")).unionByName(part.where("p_size = 50").select(key(0).alias("child"), key(4).alias("parent")))
    return graph.ancestors(edges, "1")


#: Forms of a range over major, minor, patch and the number of a pre-release, each with the interval it stands for in SQL: keys [major, minor, patch, tail], a tail of -1 before
#: all pre-releases, of 1000 for the release itself.
_FORMS = (
    ("^{a}.{b}.{c}", "[a, b, c, 1000]", "[a + 1, 0, 0, -1]"),
    ("~{a}.{b}.{c}", "[a, b, c, 1000]", "[a, b + 1, 0, -1]"),
    (">={a}.{b}.{c}", "[a, b, c, 1000]", "[1e6, 0, 0, -1]"),
    ("{a}.{b}.{c}", "[a, b, c, 1000]", "[a, b, c + 1, -1]"),
    ("{a}.{b}.x", "[a, b, 0, 1000]", "[a, b + 1, 0, -1]"),
    (">= {a}.{b}.{c} <{a1}.0.0", "[a, b, c, 1000]", "[a + 1, 0, 0, -1]"),
    ("{a}.{b}.{c} - {a1}", "[a, b, c, 1000]", "[a + 2, 0, 0, -1]"),
    ("^{a1} || ^{a}", "[a, 0, 0, 1000]", "[a + 2, 0, 0, -1]"),
    ("^{a}.{b}.{c}-rc.{n}", "[a, b, c, n]", "[a + 1, 0, 0, -1]"),
    (">={a}.{b}.{c}-rc.{n}", "[a, b, c, n]", "[1e6, 0, 0, -1]"),
    ("{a}.{b}.{c}-rc.{n}+build.7", "[a, b, c, n]", "[a, b, c, n + 0.5]"),
    ("<={a}.{b}", "[0, 0, 0, 1000]", "[a, b + 1, 0, -1]"),
    (">{a}.{b}.{c}", "[a, b, c + 1, -1]", "[1e6, 0, 0, -1]"),
    ("<{a}.{b}.{c}-rc.{n}", "[0, 0, 0, 1000]", "[a, b, c, n]"),
    ("latest", "NULL", "NULL"),
)
_N_FORMS = len(_FORMS)


def _form_sql(form: str, side: str, place: int) -> str:
    return f"CASE {form} " + " ".join(f"WHEN {i} THEN CAST({f[place]} AS DOUBLE[])" for i, f in enumerate(_FORMS)) + f" END AS {side}"


@query(
    f"""WITH p AS (SELECT p_partkey, p_partkey % {_N_FORMS} AS i, p_partkey // {_N_FORMS} % {_N_FORMS} AS j, 1 + p_partkey % 3 AS a, p_partkey // 3 % 3 AS b, p_partkey // 9 % 2 AS c, p_partkey % 12 AS n,
  1 + p_size % 3 AS a2, p_size // 3 % 3 AS b2, p_size // 9 % 2 AS c2, p_size % 12 AS n2 FROM part),
r AS (SELECT p_partkey, i, a, {_form_sql("i", "lo", 1)}, {_form_sql("i", "hi", 2)} FROM p), c AS (SELECT p_partkey, {_form_sql("j", "clo", 1)}, {_form_sql("j", "chi", 2)} FROM (SELECT p_partkey, j, a2 AS a, b2 AS b, c2 AS c, n2 AS n FROM p))
SELECT p_partkey, coalesce(CASE WHEN lo[4] = 1000 THEN [lo[1], lo[2], lo[3], -1] ELSE lo END <= clo AND chi <= hi
  AND (clo[4] NOT BETWEEN 0 AND 999 OR lo <= clo AND NOT (i = 7 AND clo[1] = a + 1 AND clo[2] = 0 AND clo[3] = 0)), false) AS allows
FROM r JOIN c USING (p_partkey)"""
)
def range_forms(spark, sf_dir):
    """For every part one form of a range as required and one as the consumer's, with numbers from the part."""
    part = _dealt(_table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    whole = lambda name, by: F.floor(F.col(name) / by)

    def text(form, **numbers):
        texts = []
        for f, _, _ in _FORMS:
            pieces = [x for x in re.split(r"(\{\w+\})", f) if x]
            texts.append(F.concat(*[numbers[x[1:-1]].cast("string") if x.startswith("{") else F.lit(x) for x in pieces]))
        return F.get(F.array(*texts), form.cast("int"))

    def numbers(name):
        a = 1 + F.col(name) % 3
        return {"a": a, "a1": a + 1, "b": whole(name, 3) % 3, "c": whole(name, 9) % 2, "n": F.col(name) % 12}

    rows = part.select("p_partkey", text(F.col("p_partkey") % _N_FORMS, **numbers("p_partkey")).alias("required"), text(whole("p_partkey", _N_FORMS) % _N_FORMS, **numbers("p_size")).alias("consumer"))
    return rows.select("p_partkey", vs.range_allows(F.col("required"), F.col("consumer")).alias("allows"))


@query(
    """WITH a AS (SELECT user_id || '/' || (props ->> 'k') AS file, extract(hour FROM ts) // 8 AS chunk, ts, event_id, value, CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'empty' WHEN 'purchase' THEN 'timeout' WHEN 'signup' THEN 'failed' ELSE 'error' END AS outcome FROM events),
t AS (SELECT *, row_number() OVER (PARTITION BY file, chunk ORDER BY ts, event_id) AS attempt FROM a),
c AS (SELECT file, chunk, count(*) AS n, max(value) > 50 AS tests FROM a GROUP BY ALL UNION ALL SELECT file, 9, 1, false FROM a GROUP BY file HAVING max(value) > 20),
z AS (SELECT file, sum(n) AS requests FROM c GROUP BY 1), m AS (SELECT file, max(chunk) AS top FROM t GROUP BY 1),
l AS (SELECT file, top, arg_max(outcome, attempt) AS o, max(attempt) AS k, arg_max(ts, attempt) AS ended, count(*) FILTER (outcome = 'timeout') AS late FROM t JOIN m USING (file) WHERE chunk = top GROUP BY ALL),
d AS (SELECT *, CASE WHEN o = 'empty' AND k = 1 THEN 'empty' WHEN o = 'timeout' AND requests > 1 AND late = 1 THEN 'timeout' WHEN o IN ('ok', 'empty') OR o = 'failed' AND late > 0 THEN 'next' ELSE 'none' END AS move,
  (SELECT min(chunk) FROM c WHERE c.file = l.file AND c.chunk > top) AS later FROM l JOIN z USING (file)),
s AS (SELECT *, CASE WHEN move = 'none' THEN 'stopped' WHEN move = 'next' AND later IS NULL THEN 'done' ELSE 'due' END AS state, CASE WHEN move = 'next' THEN coalesce(later, top) ELSE top END AS go FROM d)
SELECT s.file, state, CAST(go AS INT) AS chunk, CAST(CASE WHEN state = 'due' THEN CASE WHEN move = 'next' THEN 1 ELSE k + 1 END END AS INT) AS attempt,
  CAST(CASE WHEN state = 'due' THEN CASE WHEN requests = 1 THEN CASE WHEN tests THEN 15 ELSE 5 END WHEN tests THEN least(30 + n, 50) ELSE least(22 + n, 40) END END AS INT) AS turns,
  CASE WHEN state = 'due' THEN CASE move WHEN 'empty' THEN epoch_us(ended) + 2000000 WHEN 'timeout' THEN epoch_us(ended) + 10000000 END END AS due, CASE WHEN state = 'due' THEN move ELSE o END AS reason
FROM s JOIN c ON c.file = s.file AND c.chunk = go"""
)
def attempts_due(spark, sf_dir):
    """Events as attempts at a model: what is to be sent next of each file, and when."""
    kind = F.col("event_type")
    outcome = F.when(kind == "click", "ok").when(kind == "view", "empty").when(kind == "purchase", "timeout").when(kind == "signup", "failed").otherwise("error")
    file = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k"))
    rows = _table(spark, sf_dir, "events").select(file.alias("file"), F.floor(F.hour("ts") / 8).cast("int").alias("chunk"), "ts", "event_id", "value", outcome.alias("outcome"))
    made = rows.select("file", "chunk", F.row_number().over(Window.partitionBy("file", "chunk").orderBy("ts", "event_id")).alias("attempt"), "outcome", F.col("ts").alias("ended"))
    chunks = rows.groupBy("file", "chunk").agg(F.count("*").alias("n"), (F.max("value") > 50).alias("tests"))
    more = rows.groupBy("file").agg(F.max("value").alias("most")).where("most > 20").select("file", F.lit(9).alias("chunk"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("tests"))
    stand = attempts.standing(chunks.unionByName(more), made)
    return stand.withColumn("due", F.unix_micros("due"))


#: Documents whose texts stand in a file of published_files.
DOCUMENTS_PER_PUBLISHED = 100


@query(
    f"""WITH files AS (SELECT doc_id // {DOCUMENTS_PER_PUBLISHED} AS file, string_agg(text, chr(10) ORDER BY doc_id) AS body FROM documents GROUP BY 1),
ended AS (SELECT file, string_split_regex(regexp_replace(body, '\\r?\\n$', ''), '\\r?\\n') AS ls, CASE WHEN file % 2 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS ending FROM files),
after AS (SELECT file, list_transform(ls, lambda x: replace(x, 'the', 'THE')) AS new, ls, ending FROM ended)
SELECT CAST(file AS VARCHAR) AS file, md5(array_to_string(new, chr(10)) || ending) AS h FROM after WHERE new <> ls"""
)
def published_files(spark, sf_dir):
    """Documents as files of many, with two kinds of endings: what a rename changes is written as one run and read back."""
    texts = _table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / DOCUMENTS_PER_PUBLISHED).alias("file"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    whole = texts.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
    body = F.when(F.col("text").endswith("\r\n"), F.left("text", F.length("text") - 2)).when(F.col("text").endswith("\n"), F.left("text", F.length("text") - 1)).otherwise(F.col("text"))
    files = whole.select("file", F.concat(body, F.when(F.col("file") % 2 == 0, "\r\n").otherwise("\n")).alias("text"))
    files = graph.saved(files.select(F.col("file").cast("string").alias("file"), "text"))
    lines = readers.source_lines(files)
    edits = lines.where("contains(text, 'the')").select("file", "line", F.lit(0).alias("seq"), F.lit("the").alias("old_text"), F.lit("THE").alias("new_text"), F.lit("r").alias("rule_id"), F.lit(True).alias("replace_all"))
    folder, run = f"{graph.checkpoint_folder(spark)}/published-{uuid.uuid4().hex}", "first"
    writer.publish(ed.changed_files(edits, lines, ed.endings(files)), folder, run)
    return writer.published(spark, folder, run).select("file", F.md5(F.col("text").cast("binary")).alias("h"))


_NOISY = """q AS (SELECT user_id AS file, event_id AS seq, event_id % 100 AS line, 'F' || (event_id % 5) AS family, 'r' || event_type AS rule_id,
  CASE WHEN (props ->> 'k')[-1] < '4' THEN 'its base class changed' WHEN (props ->> 'k')[-1] < '6' THEN 'RefAttributes ' || event_type WHEN (props ->> 'k')[-1] < '8' THEN 'type changed from x' ELSE props END AS message,
  ['family=F' || (event_id % 5), CASE event_type WHEN 'signup' THEN 'change-type=signature-changed' WHEN 'error' THEN 'change-type=type-changed' ELSE 'change-type=' || event_type END] AS labels, 'snip ' || event_type AS snip, 't' || (event_id % 7) AS test FROM events)"""


def _noisy_requests(spark, sf_dir):
    family, last = F.concat(F.lit("F"), (F.col("event_id") % 5).cast("string")), F.right(F.get_json_object("props", "$.k"), F.lit(1))
    kind = F.col("event_type")
    message = F.when(last < "4", "its base class changed").when(last < "6", F.concat(F.lit("RefAttributes "), kind)).when(last < "8", "type changed from x").otherwise(F.col("props"))
    change = F.when(kind == "signup", "signature-changed").when(kind == "error", "type-changed").otherwise(kind)
    labels = F.array(F.concat(F.lit("family="), family), F.concat(F.lit("change-type="), change))
    tests = F.array(F.concat(F.lit("t"), (F.col("event_id") % 7).cast("string")))
    return _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("file"), F.col("event_id").alias("seq"), (F.col("event_id") % 100).cast("int").alias("line"), family.alias("family"), F.concat(F.lit("r"), kind).alias("rule_id"), message.alias("message"), labels.alias("labels"),
        F.concat(F.lit("snip "), kind).alias("code_snip"), tests.alias("companion_tests"),
    )


@query(
    f"""WITH {_NOISY}, n AS (SELECT *, (contains(message, 'base class changed') OR contains(message, 'RefAttributes')) AND list_has_any(labels, ['change-type=signature-changed', 'change-type=type-changed']) AS noise FROM q),
k AS (SELECT *, noise AND bool_or(NOT noise) OVER (PARTITION BY file, family) AS gone FROM n),
m AS (SELECT file, family, string_agg(message, chr(10) ORDER BY s) AS message FROM (SELECT file, family, message, min(seq) AS s FROM k WHERE NOT gone GROUP BY ALL) GROUP BY ALL),
l AS (SELECT file, family, string_agg(label, ',' ORDER BY s, i) AS labels FROM (SELECT file, family, label, min(seq) AS s, arg_min(i, seq) AS i FROM (SELECT file, family, seq, unnest(labels) AS label, unnest([1, 2]) AS i FROM k WHERE NOT gone) GROUP BY file, family, label) GROUP BY ALL),
p AS (SELECT file, family, string_agg(snip, ',' ORDER BY s) AS snippets FROM (SELECT file, family, snip, min(seq) AS s FROM k WHERE NOT gone GROUP BY ALL) GROUP BY ALL)
SELECT file, 'family:' || family AS key, CAST(min(line) FILTER (NOT gone) AS INT) AS line, any_value(m.message) AS message, count(*) AS n, any_value(l.labels) AS labels, any_value(p.snippets) AS snippets, string_agg(DISTINCT test, ',' ORDER BY test) AS companion_tests
FROM k JOIN m USING (file, family) JOIN l USING (file, family) JOIN p USING (file, family) GROUP BY file, family"""
)
def family_noise(spark, sf_dir):
    """Requests of families of which many tell of types only."""
    found = requests.consolidated(_noisy_requests(spark, sf_dir))
    return found.select("file", "key", "line", "message", "n", *[F.array_join(c, ",").alias(c) for c in ("labels", "snippets", "companion_tests")])


@query(
    f"""WITH {_NOISY}, asks AS (SELECT * FROM q WHERE rule_id = 'rview')
SELECT 'test-fix:' || arg_min(rule_id, seq) AS rule_id, test AS file, 1 AS line, min(seq) AS seq, 'change-type=test-fix,impact=frontend-testing' AS labels, true AS made FROM asks GROUP BY test
UNION ALL SELECT rule_id, CAST(file AS VARCHAR), CAST(line AS INT), seq, CASE WHEN rule_id = 'rview' THEN 'change-type=test-impact' ELSE array_to_string(labels, ',') END, false FROM q"""
)
def test_requests_behind(spark, sf_dir):
    """Requests of which those of one rule touch tests only, and behind them one for each of their companion tests."""
    rows = _noisy_requests(spark, sf_dir)
    rows = rows.withColumn("labels", F.when(F.col("rule_id") == "rview", F.array(F.lit("change-type=test-impact"))).otherwise(F.col("labels"))).withColumn("file", F.col("file").cast("string"))
    found = requests.with_test_requests(rows)
    return found.select("rule_id", "file", "line", "seq", F.array_join("labels", ",").alias("labels"), F.col("family").isNull().alias("made"))


@query(
    f"""WITH {LINES}, w AS (SELECT file, line, list_filter(string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' '), lambda x: x <> '')[1:8] AS ws FROM lines),
i AS (SELECT file, line, ws, list_contains(ws, 'the') AS hit FROM w WHERE len(ws) > 0), t AS (SELECT file FROM i GROUP BY file HAVING bool_or(hit)),
n AS (SELECT file, line, list_transform(ws, lambda x: CASE WHEN x = 'the' THEN 'of' ELSE x END) AS ws, hit FROM i JOIN t USING (file)),
d AS (SELECT file, line, hit, list_filter(ws, lambda x, k: list_position(ws, x) = k) AS ws FROM n)
SELECT file, CAST(line AS INT) AS line, md5('import {{ ' || array_to_string(ws, ', ') || ' }} from "m";') AS h, count(*) OVER (PARTITION BY file) AS n_before, true AS changed FROM d"""
)
def provider_hooks(spark, sf_dir):
    """Lines of documents as imports of their first words, of which one is renamed: the provider notes the lines of each file before, tidies them, and tells after which files changed."""
    lines = _lines(spark, sf_dir)
    # ten parts hold the first eight words: at most the first part is empty, and the last is what is left of the line
    words = F.slice(F.filter(F.split("text", "[^A-Za-z]+", 10), lambda x: x != ""), 1, 8)
    imports = _dealt(lines.select("file", "line", words.alias("ws")).where("size(ws) > 0"))
    source = graph.saved(imports.select("file", "line", F.concat(F.lit("import { "), F.array_join("ws", ", "), F.lit(' } from "m";')).alias("text"), F.array_contains("ws", "the").alias("hit")))
    edits = source.where("hit").select("file", "line", F.lit(0).alias("seq"), F.lit("the").alias("old_text"), F.lit("of").alias("new_text"), F.lit("r").alias("rule_id"), F.lit(True).alias("replace_all"))
    noting = dataclasses.replace(
        providers.JAVASCRIPT, name="noting", before=lambda own: own.groupBy("file").agg(F.count("*").alias("n_before")), after=lambda changed, noted: changed.join(noted, "file", "left").select("file", "n_before", F.lit(True).alias("changed"))
    )
    # whole names only: a name that holds the old one is put behind a mark while edits are applied
    marked = source.select("file", "line", F.regexp_replace("text", "(?<=[A-Za-z])the|the(?=[A-Za-z])", "t\u0001he").alias("text"))
    done = providers.applied(edits, marked, noting)
    rows = done.lines.join(done.follow_up, "file")
    return rows.select("file", "line", F.md5(F.replace("text", F.lit("\u0001"), F.lit("")).cast("binary")).alias("h"), "n_before", "changed")


@query(
    f"""WITH {LINES}, seen AS (SELECT file, line, text FROM lines), now AS (SELECT file, line, CASE WHEN length(text) % 7 = 0 THEN text || ' new' ELSE text END AS text FROM lines),
d AS (SELECT DISTINCT doc_id AS file, doc_id % 5 + 1 AS line FROM documents WHERE text IS NOT NULL),
b AS (SELECT file, line, 'the' AS old_text, 'THE' AS new_text, unnest([1, 2]) AS block FROM d UNION ALL SELECT file, line, 'nowhere to be found', 'x', 3 FROM d UNION ALL SELECT file, 900000, 'the', 'THE', 4 FROM d),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.file ORDER BY block) AS seq, s.text AS before, n.text AS after FROM b LEFT JOIN seen s ON s.file = b.file AND s.line = b.line LEFT JOIN now n ON n.file = b.file AND n.line = b.line)
SELECT file, CAST(line AS INT) AS line, CAST(seq AS INT) AS seq, old_text, 'llm' AS source, 'medium' AS confidence,
  CASE WHEN before IS NULL THEN 'line_out_of_bounds' WHEN before <> after THEN 'stale' WHEN NOT contains(after, old_text) THEN 'text_not_found_on_line' WHEN block = 2 THEN 'repeated' ELSE 'planned' END AS outcome FROM o"""
)
def answer_edits(spark, sf_dir):
    """For every document an answer with fix blocks that repeat, that miss, and that name no line, after some lines have changed."""
    docs, lines = _table(spark, sf_dir, "documents").where("text is not null"), _lines(spark, sf_dir)
    block = lambda line, old, new: F.concat(F.lit("```fix\nLINE: "), line.cast("string"), F.lit(f"\nOLD:{old}\nNEW:{new}\n```\n"))
    at = F.col("doc_id") % 5 + 1
    said = docs.select("doc_id", F.concat(block(at, "the", "THE"), F.lit("words\n"), block(at, "the", "THE"), block(at, "nowhere to be found", "x"), block(F.lit(900000), "the", "THE")).alias("text"))
    blocks = requests.fix_blocks(readers.source_lines(said, "doc_id", "text")).withColumn("rule_id", F.lit("r"))
    now = lines.withColumn("text", F.when(F.length("text") % 7 == 0, F.concat("text", F.lit(" new"))).otherwise(F.col("text")))
    return requests.answer_edits(blocks, requests.line_digests(lines), now).select("file", "line", "seq", "old_text", "source", "confidence", "outcome")


@query(
    """WITH t AS (SELECT p_partkey AS k, '/p/src/main/j/C' || p_partkey || '.java' AS file, p_size AS z FROM part),
l AS (SELECT k, '/p/src/test/j/C' || k || CASE z % 3 WHEN 0 THEN 'Test.java' ELSE 'Tests.java' END AS test FROM t WHERE z % 3 < 2 UNION ALL SELECT k, '/p/src/main/j/C' || k || 'IT.java' FROM t WHERE z > 40 UNION ALL SELECT k, '/p/src/test/j/C' || k || 'Spec.java' FROM t)
SELECT t.file, coalesce(string_agg(l.test, ',' ORDER BY l.test) FILTER (NOT ends_with(l.test, 'Spec.java')), '') AS tests FROM t JOIN l USING (k) GROUP BY t.file"""
)
def java_companions(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    path = lambda tree, end: F.concat(F.lit(f"/p/src/{tree}/j/C"), F.col("p_partkey").cast("string"), F.lit(end))
    test, size = path("test", "Test.java"), F.col("p_size")
    listing = part.where(size % 3 == 0).select(test.alias("path")).unionByName(part.where(size % 3 == 1).select(path("test", "Tests.java").alias("path"))).unionByName(part.where(size > 40).select(path("main", "IT.java").alias("path"))).unionByName(part.select(path("test", "Spec.java").alias("path")))
    found = pl.java_companion_tests(part.select(path("main", ".java").alias("file")), listing)
    return found.select("file", F.array_join("companion_tests", ",").alias("tests"))


@query(
    f"""WITH {LINES}, m(old_text, new_text) AS (VALUES ('the', 'THE'), ('tion', 'TION')),
i AS (SELECT doc_id AS file, CASE WHEN doc_id % 11 > 0 THEN doc_id % 5 + 1 END AS place, doc_id % 3 = 0 AS whole, CASE doc_id % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'none' ELSE 'the' END AS matched FROM documents),
j AS (SELECT *, CASE WHEN place IS NULL THEN 'no_line_number' WHEN NOT whole AND matched = 'same' THEN 'no_op_rename' END AS lost FROM i),
e AS (SELECT j.file, line, old_text, whole FROM j JOIN lines l ON l.file = j.file JOIN m ON contains(text, old_text) WHERE lost IS NULL AND whole
  UNION ALL SELECT file, place, 'the', false FROM j WHERE lost IS NULL AND NOT whole AND matched = 'the'
  UNION ALL SELECT j.file, line, old_text, false FROM j JOIN lines l ON l.file = j.file AND line BETWEEN place - CASE matched WHEN 'the' THEN 3 ELSE 1 END AND place + 4 JOIN m ON contains(text, old_text) WHERE lost IS NULL AND NOT whole AND NOT (matched = 'the' AND line = place AND old_text = 'the'))
SELECT file, CAST(line AS INT) AS line, old_text, whole AS replace_all, CAST(NULL AS VARCHAR) AS reason FROM e
UNION ALL SELECT file, CAST(place AS INT), NULL, false, lost FROM j WHERE lost IS NOT NULL
UNION ALL SELECT file, CAST(place AS INT), NULL, false, 'text_not_found' FROM j WHERE lost IS NULL AND NOT EXISTS (SELECT 1 FROM e WHERE e.file = j.file)"""
)
def rename_incidents(spark, sf_dir):
    """A rename's incident in every document: all over the file, about a mapping that it matched, near its line, with nothing to rename, or without a line."""
    docs = _table(spark, sf_dir, "documents")
    mapping = lambda old, new: F.struct(F.lit(old).alias("old_text"), F.lit(new).alias("new_text"))
    key = F.col("doc_id")
    matched = F.when(key % 4 == 0, "same").when(key % 4 == 1, "none").otherwise("the")
    incidents = docs.select(
        key.alias("seq"), F.lit("r").alias("rule_id"), key.alias("file"), F.when(key % 11 > 0, key % 5 + 1).cast("int").alias("line"), F.array(mapping("the", "THE"), mapping("same", "same"), mapping("tion", "TION")).alias("mappings"), matched.alias("matched"), (key % 3 == 0).alias("whole_file"), (key % 3 == 0).alias("replace_all")
    )
    return pl.rename_rows(incidents, _lines(spark, sf_dir)).select("file", "line", "old_text", "replace_all", "reason")


@query(
    """WITH e AS (SELECT event_id, event_type AS t, props ->> 'k' AS k FROM events)
SELECT event_id, CASE t WHEN 'click' THEN 'old' WHEN 'view' THEN 'old' WHEN 'purchase' THEN CASE WHEN k = '7' THEN '7' ELSE 'old' END WHEN 'error' THEN 'p' || k ELSE 'C' || k END AS matched_js,
  CASE t WHEN 'signup' THEN 'i' || k WHEN 'error' THEN 'org.x.A' || k ELSE '' END AS matched_java, CASE t WHEN 'signup' THEN 'N' || k WHEN 'error' THEN 'A' || k ELSE '' END AS annotation FROM e"""
)
def matched_names(spark, sf_dir):
    """What an incident matched, by language and for renames whose old names it may have as a value, and the annotation it is about."""
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k")
    text = lambda c: F.parse_json(F.to_json(F.struct(c.alias("v"))))
    value = lambda c: F.variant_get(text(c), "$.v", "variant")
    lit = lambda s: F.lit(s)
    entries = (
        F.when(kind == "click", F.map_from_arrays(F.array(lit("propName")), F.array(value(lit("old")))))
        .when(kind == "view", F.map_from_arrays(F.array(lit("propName"), lit("propValue")), F.array(value(lit("zz")), value(lit("old")))))
        .when(kind == "purchase", F.map_from_arrays(F.array(lit("componentName"), lit("propObjectValues")), F.array(value(lit("zz")), value(F.array(k, lit("old"))))))
        .when(kind == "error", F.map_from_arrays(F.array(lit("propName"), lit("propObjectValues"), lit("matchingText")), F.array(value(F.concat(lit("p"), k)), value(F.array(lit("none"))), value(F.concat(lit("org.x.A"), k)))))
        .otherwise(F.map_from_arrays(F.array(lit("componentName"), lit("importedName"), lit("annotationName")), F.array(value(F.concat(lit("C"), k)), value(F.concat(lit("i"), k)), value(F.concat(lit("@org.y.N"), k)))))
    )
    rows = _table(spark, sf_dir, "events").select("event_id", entries.alias("variables"))
    mappings = F.array(*[F.struct(F.lit(o).alias("old_text"), F.lit("n").alias("new_text")) for o in ("old", "7")])
    return rows.select("event_id", pl.matched_for(mappings, pl.MATCHED_JS).alias("matched_js"), pl.matched_text(pl.MATCHED_JAVA).alias("matched_java"), pl.annotation_name().alias("annotation"))


@query(
    """WITH p AS (SELECT p_partkey AS file, p_size % 4 AS m, p_size % 5 = 0 AS open FROM part), n AS (SELECT file, m, unnest(range(2, m + 4)) AS line FROM p WHERE NOT open)
SELECT file, CAST(line AS INT) AS line, CASE WHEN line = 2 THEN '  onX={() => {' WHEN line = m + 3 THEN '  }}' ELSE '    go(' || line || ');' END AS old_text, '' AS new_text, CAST(NULL AS VARCHAR) AS reason FROM n
UNION ALL SELECT file, 2, NULL, NULL, 'unbalanced_brackets' FROM p WHERE open"""
)
def attribute_runs(spark, sf_dir):
    """For every part a tag with an attribute over several lines, which goes as a whole, or which is never closed."""
    part = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), (F.col("p_size") % 4).cast("int").alias("m"), (F.col("p_size") % 5 == 0).alias("open"))
    inner = F.transform(F.sequence(F.lit(3), F.col("m") + 3), lambda i: F.concat(F.lit("    go("), i.cast("string"), F.lit(");")))
    body = F.concat(F.array(F.lit("<A"), F.lit("  onX={() => {")), F.slice(inner, 1, F.col("m")), F.when(F.col("open"), F.array(F.lit("  {"))).otherwise(F.array(F.lit("  }}"))), F.array(F.lit("  y={1}/>")))
    lines = part.select("file", F.posexplode(body).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")
    incidents = part.select(F.col("file").alias("seq"), "file", F.lit(2).alias("line"), F.lit("onX").alias("name"))
    return planning.attribute_removals(incidents, lines).select("file", "line", "old_text", "new_text", "reason")
