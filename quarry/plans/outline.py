"""The outline of source files: risk, defects, ghosts and notes of every definition, what folds, and what is shown whole.

All rules are columns and joins over the chunks of a collection: a definition is a ghost if
no other file has its name, which a minimum and a maximum per name tell; notes join by file and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.code import judged
from quarry.functions.text import extension, identifiers, token_estimate
from quarry.plans.definitions import define_chunks
from quarry.plans.stored import cut
from quarry.registry import query
from quarry.sources.corpus import CHUNKS_OF_SOURCES_SQL, pieces, source_files

# Files that a runtime or a test calls, by the beginning of their name and by a part of their path.
ENTRIES, TESTS = r"(?i)^(?:index|main|app|setup|server|cli|vite-env)\.|^(?:.*\.)?config\.", r"(?i)\.(?:test|spec)\."
#: Lines of a definition that is shown whole, and tokens of all of a file that are.
EXPANDED_LINES, EXPANDED_TOKENS = 150, 6_000


def _exported(path: Column, name: Column, code: Column) -> Column:
    ext = extension(path)
    return F.when(ext == ".go", name.rlike("^[A-Z]")).when(ext == ".py", ~name.startswith("_")).otherwise(code.rlike(r"^export\b"))


def ghosts(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """path, name of the exported definitions that no other file names; types, private names and entry files have none."""
    base = F.regexp_extract("path", "[^/]*$", 0)
    exported = F.col("exported") if "exported" in chunks.columns else _exported(F.col("path"), F.col("name"), F.col("code"))
    asked = chunks.where(exported & ~F.col("kind").isin("type", "interface") & ~F.col("name").startswith("_") & ~base.rlike(ENTRIES) & ~F.col("path").rlike(TESTS))
    asked = asked.select("path", "name").distinct()
    words = files.select("path", F.explode(identifiers(F.col("code"))).alias("name"))
    # Only names that are asked for are grouped.
    met = words.join(asked.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    elsewhere = (F.col("lo") != F.col("path")) | (F.col("hi") != F.col("path"))
    return asked.join(met, "name", "left").where(~F.coalesce(elsewhere, F.lit(False))).select("path", "name")


def outline_rows(files: DataFrame, chunks: DataFrame, notes: DataFrame, budget: int = EXPANDED_TOKENS) -> DataFrame:
    """path, name, start, kind, first_line, last_line, risk, defects, ghost, note, stale, folded, expanded.

    ``notes``: path, name, insight, hash (of the definition's text when the note was made).  A note holds while
    the text is the same, and for ever if it begins with ASSERT; else it is stale.  A definition of low
    risk without a holding note, a defect or a ghost's mark folds.  Of high risk the longest of a file
    are shown whole while the budget of tokens lasts; one that does not fit is passed over.
    """
    lines = F.col("last_line") - F.col("first_line") + 1
    # What is asked of a text is found once, where the text is; joins and windows see no text.
    seen = {"exported": _exported(F.col("path"), F.col("name"), F.col("code")), "digest": F.sha2(F.col("code").cast("binary"), 256), "tokens": token_estimate(F.col("code"))}
    facts = cut(judged(chunks.withColumn("lines", lines)).withColumns(seen).select("path", "name", "start", "kind", "first_line", "last_line", "lines", "risk", "defects", *seen))
    rows = facts.join(ghosts(files, facts).withColumn("ghost", F.lit(True)), ["path", "name"], "left").withColumn("ghost", F.coalesce("ghost", F.lit(False)))
    # The last of several notes on one definition counts, by their text.
    known = notes.groupBy("path", "name").agg(F.max(F.struct("insight", "hash")).alias("n")).select("path", "name", "n.insight", "n.hash")
    rows = rows.join(known, ["path", "name"], "left")
    holds = (F.col("hash") == F.col("digest")) | F.upper("insight").startswith("ASSERT")
    rows = rows.withColumn("holds", F.coalesce(holds, F.lit(False)))
    rows = rows.withColumn("folded", (F.col("risk") == "LOW") & ~F.col("holds") & (F.size("defects") == 0) & ~F.col("ghost"))
    # Places, sizes and tokens of a file's definitions of high risk.
    high = facts.where((F.col("risk") == "HIGH") & (F.col("lines") <= EXPANDED_LINES)).select("path", F.struct((-F.col("lines")).alias("o"), "start", F.col("tokens").alias("t")).alias("x"))
    none = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("taken"))
    take = lambda a, x: F.when(a["used"] + x["t"] <= budget, F.struct((a["used"] + x["t"]).alias("used"), F.concat(a["taken"], F.array(x["start"])).alias("taken"))).otherwise(a)
    chosen = high.groupBy("path").agg(F.array_sort(F.collect_list("x")).alias("l")).select("path", F.explode(F.aggregate("l", none, take)["taken"]).alias("start")).withColumn("expanded", F.lit(True))
    out = rows.join(chosen, ["path", "start"], "left")
    note, stale = F.when(F.col("holds"), F.col("insight")), F.col("insight").isNotNull() & ~F.col("holds")
    return out.select("path", "name", "start", "kind", "first_line", "last_line", "risk", "defects", "ghost", note.alias("note"), stale.alias("stale"), "folded", F.coalesce("expanded", F.lit(False)).alias("expanded"))


def outline_texts(rows: DataFrame) -> DataFrame:
    """path, text: a line for each definition that does not fold, and one with the names of those that do."""
    marks = F.concat_ws("", F.when(F.size("defects") > 0, F.concat(F.lit(" ["), F.array_join("defects", ", "), F.lit("]"))), F.when(F.col("ghost"), F.lit(" [0 ext refs]")))
    note = F.when(F.col("note").isNotNull(), F.concat(F.lit("\n  note: "), "note")).when(F.col("stale"), F.lit("\n  note is stale: the code has changed")).otherwise("")
    line = F.concat(F.lit("- "), "kind", F.lit(" "), "name", F.lit(" ["), "risk", F.lit("]"), marks, F.format_string(" L%d-L%d", "first_line", "last_line"), note)
    ordered = F.array_sort(F.collect_list(F.struct("start", "folded", "name", line.alias("line"))))
    of = lambda folded, field: F.transform(F.filter("l", lambda x: x["folded"] == folded), lambda x: x[field])
    count = F.size(of(True, "name"))
    low = F.when(count > 0, F.concat(count.cast("string"), F.lit(" of low risk: "), F.array_join(of(True, "name"), ", ")))
    return rows.groupBy("path").agg(ordered.alias("l")).select("path", F.concat_ws("\n", of(False, "line"), low).alias("text"))


_NOTES = "CASE o % 4 WHEN 0 THEN 'holds ' || o WHEN 1 THEN 'Assert ' || o WHEN 2 THEN 'old ' || o END"
_BUDGET = 100
_ROWS_SQL = f"""{CHUNKS_OF_SOURCES_SQL},
own AS (SELECT *, CAST(nullif(regexp_extract(name, '\\d+$'), '') AS BIGINT) AS o FROM source_chunks WHERE path LIKE 'src/%'),
used AS (SELECT DISTINCT p AS o FROM links WHERE pc <> c),
marked AS (
  SELECT path, name, start, kind, first_line, last_line, CASE WHEN name LIKE 'process%' THEN 'HIGH' ELSE 'LOW' END AS risk, CASE WHEN name LIKE 'process%' THEN 'type-escape-any' ELSE '' END AS defects,
    code LIKE 'export %' AND NOT (name LIKE 'order%' AND o IN (SELECT o FROM used)) AS ghost,
    CASE WHEN name LIKE 'order%' AND o % 4 < 2 THEN {_NOTES} END AS note, name LIKE 'order%' AND o % 4 = 2 AS stale,
    name LIKE 'process%' AND row_number() OVER (PARTITION BY path, name LIKE 'process%' ORDER BY start) <= 2 AS expanded FROM own)"""


@query("r10_outline_rows", f"WITH {_ROWS_SQL} SELECT *, risk = 'LOW' AND note IS NULL AND NOT ghost AS folded FROM marked")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders have notes: on the text that they have, as an assertion on another text, on another text, or none."""
    rows = _outlined(spark, sf_dir)
    return rows.withColumn("defects", F.array_join("defects", ","))


def _outlined(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cut(source_files(spark, sf_dir).where(F.col("path").endswith(".ts")))
    o = F.regexp_extract("name0", r"\d+$", 0).cast("long")
    # The texts as the tables give them, not as they were read from the files.
    own = pieces(spark, sf_dir).where("name0 LIKE 'order%'").select("path", F.col("name0").alias("name"), "own0", o.alias("o")).where("o % 4 < 3")
    insight = F.element_at(F.array(*map(F.lit, ("holds ", "Assert ", "old "))), (F.col("o") % 4 + 1).cast("int"))
    digest = F.sha2(F.when(F.col("o") % 4 == 0, F.col("own0")).otherwise("another text").cast("binary"), 256)
    notes = own.select("path", "name", F.concat(insight, F.col("o").cast("string")).alias("insight"), digest.alias("hash"))
    return outline_rows(files, define_chunks(files), notes, _BUDGET)


@query("r10_outline_texts", f"""WITH {_ROWS_SQL}, f AS (SELECT *, risk = 'LOW' AND note IS NULL AND NOT ghost AS folded FROM marked)
  SELECT path, concat_ws(chr(10), string_agg('- ' || kind || ' ' || name || ' [' || risk || ']' || CASE WHEN defects <> '' THEN ' [' || defects || ']' ELSE '' END || CASE WHEN ghost THEN ' [0 ext refs]' ELSE '' END || ' L' || first_line || '-L' || last_line
      || CASE WHEN note IS NOT NULL THEN chr(10) || '  note: ' || note WHEN stale THEN chr(10) || '  note is stale: the code has changed' ELSE '' END, chr(10) ORDER BY start) FILTER (WHERE NOT folded),
    CASE WHEN count(*) FILTER (WHERE folded) > 0 THEN count(*) FILTER (WHERE folded) || ' of low risk: ' || string_agg(name, ', ' ORDER BY start) FILTER (WHERE folded) END) AS text FROM f GROUP BY 1""")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outline_texts(_outlined(spark, sf_dir))
