"""File edits written as text in a reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepscope.functions import text as tt

# --- fixed values: the three edit formats and what counts as a file name ---
SEARCH_REPLACE = r"(?s)<{5,9}\s*SEARCH\s*\n(.*?)\n?={5,9}\s*\n(.*?)\n?>{5,9}\s*REPLACE"
UNIFIED = (
    r"(?:^|\n)(?:---|\+\+\+)\s+(?:[ab]/)?([^\s\n]+)\s*\n(?:\+\+\+|---)\s+(?:[ab]/)?([^\s\n]+)\s*\n"
    r"(@@\s*-\d+.*?\n[\s\S]*?)(?=(?:\n---|\z))"
)
WHOLE = (
    r"(?:^|\n)(?:(?:#+|\*+)?\s*([a-zA-Z0-9_./\\-]+\.[a-zA-Z0-9_]+)\s*(?:#+|\*+)?\s*\n)?"
    r"```[a-zA-Z0-9_]*\s*\n"
    r"(?:(?:#|//|<!--)\s*(?:file(?:name)?:?\s*)?([a-zA-Z0-9_./\\-]+\.[a-zA-Z0-9_]+)\s*\n)?"
    r"([\s\S]*?)\n```"
)
FILE_NAME = (
    r"([`'\"]?)((?:[a-zA-Z0-9_.\-]+[/\\])*[a-zA-Z0-9_.\-]+\.[a-zA-Z0-9_]+)([`'\"]?)([:`'\s,\)]|$)"
)
BARE_FILE = r"^(?:[a-zA-Z0-9_.\-]+[/\\])*[a-zA-Z0-9_.\-]+\.[a-zA-Z0-9_]+$"
NO_EXTENSIONS = ["0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "g", "e", "i"]
NO_FILES = ["e.g.", "i.e.", "etc.", "vs.", "al."]
CODE_LINE = r"^(?:import |from |class |def |return |if |for |while )"
LEADING_WORD = (
    r"\b(?:file|filename|filepath|in|modifying|modify|updating|update|editing|edit|patching|patch)\s*$"
)

EDGE_MARKS = r"^[#*`\-:\s]+|[#*`\-:\s]+$"
NAME_LABEL = r"(?i)^(?:file|filename|filepath):\s*"
QUOTES = "`'\"* "
# Points of a file name: alone on its line, any, quoted or before a colon, last of the
# line, behind a leading word; and how many a line loses with its distance.
ALONE, NAMED, QUOTED, LAST, ANNOUNCED = 100, 10, 25, 20, 15
NEAREST, PER_LINE = 20, 2
LINES_BACK = 10
SAMPLE_NAMES = "example|snippet"  # files that are only shown


def clean_path(col: Column) -> Column:
    bare = F.regexp_replace(tt.strip(col), EDGE_MARKS, "")
    return F.btrim(F.regexp_replace(bare, NAME_LABEL, ""), F.lit(QUOTES))


def _bad_extension(path: Column) -> Column:
    ext = F.lower(F.substring_index(path, ".", -1))
    return ext.rlike("^[0-9]+$") | ext.isin(*NO_EXTENSIONS)


_CANDIDATE = "array<struct<score:int,path:string>>"


def line_candidates(line: Column) -> Column:
    """File names of a line with a score: alone on the line, quoted, last, announced."""
    none = F.expr(f"cast(array() as {_CANDIDATE})")

    def of_line(text: Column) -> Column:
        direct = clean_path(text)
        alone = direct.rlike(BARE_FILE) & ~_bad_extension(direct)
        found = {
            part: F.regexp_extract_all(text, F.lit(FILE_NAME), F.lit(group))
            for group, part in enumerate(["all", "prefix", "path", "quote", "suffix"])
        }
        gaps = F.split(text, FILE_NAME, -1)
        zipped = F.arrays_zip(
            *[found[p].alias(p) for p in ("all", "prefix", "path", "quote", "suffix")]
        )

        def score(m: Column, i: Column) -> Column:
            path = clean_path(m["path"])
            pre = F.lower(
                F.concat(F.coalesce(F.get(found["all"], i - 1), F.lit("")), F.get(gaps, i))
            )
            at_end = (i == F.size(found["all"]) - 1) & (tt.strip(F.get(gaps, i + 1)) == "")
            mark = F.when(m["quote"] != "", m["quote"]).otherwise(m["prefix"])
            points = (
                F.lit(NAMED)
                + F.when(m["suffix"].contains(":") | (mark == "`"), QUOTED).otherwise(0)
                + F.when(at_end, LAST).otherwise(0)
                + F.when(pre.rlike(LEADING_WORD), ANNOUNCED).otherwise(0)
            )
            usable = (
                path.contains(".") & ~F.lower(path).isin(*NO_FILES) & ~_bad_extension(path)
            )
            return F.when(usable, F.struct(points.alias("score"), path.alias("path")))

        many = F.array_compact(F.transform(zipped, score)).cast(_CANDIDATE)
        one = F.array(F.struct(F.lit(ALONE).alias("score"), direct.alias("path"))).cast(_CANDIDATE)
        return (
            F.when((text == "") | text.rlike(CODE_LINE), none).when(alone, one).otherwise(many)
        )

    return tt.let(tt.strip(line), of_line)


def path_before(text: Column) -> Column:
    """The likeliest file name in the last ten lines of a text; null without one."""
    lines = F.filter(
        F.transform(F.split(text, "\n"), tt.strip), lambda s: s != ""
    )
    last = F.when(F.size(lines) > LINES_BACK, F.slice(lines, -LINES_BACK, LINES_BACK)).otherwise(lines)
    weighted = F.transform(
        F.reverse(last),
        lambda s, i: F.transform(
            line_candidates(s),
            lambda c, k: F.struct(
                (c["score"] + F.greatest(F.lit(0), F.lit(NEAREST) - i * PER_LINE)).alias("score"),
                (-i).alias("near"),
                (-k).alias("first"),
                c["path"].alias("path"),
            ),
        ),
    )
    return F.array_max(F.flatten(weighted))["path"]


_EDIT = "array<struct<path:string,format:string,search:string,replace:string>>"


def text_edits(content: Column) -> Column:
    """Edits of a reply; the first format that yields any is used."""
    text = F.coalesce(content, F.lit(""))

    def every(pattern: str, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))

    gaps = F.split(text, SEARCH_REPLACE, -1)
    search, replace = every(SEARCH_REPLACE, 1), every(SEARCH_REPLACE, 2)
    named = F.transform(F.slice(gaps, F.lit(1), F.size(search)), path_before)

    def diffs(paths: Column) -> Column:
        return F.transform(
            F.arrays_zip(search.alias("s"), replace.alias("r")),
            lambda e, i: F.struct(
                F.coalesce(
                    F.try_element_at(
                        F.filter(F.slice(paths, F.lit(1), i + 1), lambda p: p.isNotNull()),
                        F.lit(-1),
                    ),
                    F.lit("unknown_file"),
                ).alias("path"),
                F.lit("diff").alias("format"),
                e["s"].alias("search"),
                e["r"].alias("replace"),
            ),
        ).cast(_EDIT)

    unified = F.transform(
        F.arrays_zip(every(UNIFIED, 1).alias("a"), every(UNIFIED, 2).alias("b"),
                     every(UNIFIED, 3).alias("p")),
        lambda e: F.struct(
            clean_path(F.when(e["b"] != "", e["b"]).otherwise(e["a"])).alias("path"),
            F.lit("udiff").alias("format"),
            F.lit(None).cast("string").alias("search"),
            e["p"].alias("replace"),
        ),
    ).cast(_EDIT)
    whole = F.transform(
        F.arrays_zip(every(WHOLE, 1).alias("a"), every(WHOLE, 2).alias("b"),
                     every(WHOLE, 3).alias("c")),
        lambda e: F.struct(
            clean_path(F.when(e["a"] != "", e["a"]).otherwise(e["b"])).alias("path"),
            F.lit("whole").alias("format"),
            F.lit(None).cast("string").alias("search"),
            e["c"].alias("replace"),
        ),
    ).cast(_EDIT)
    whole = F.filter(
        whole,
        lambda e: e["path"].contains(".") & ~F.lower(e["path"]).rlike(SAMPLE_NAMES),
    )
    return (
        F.when(F.size(search) > 0, tt.let(named, diffs))
        .when(F.size(unified) > 0, unified)
        .otherwise(whole)
    )


def extract_text_edits(replies: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per edit: (key, edit_no, path, format, search, replace)."""
    return replies.select(*key, F.posexplode(text_edits(F.col(text))).alias("edit_no", "e")).select(
        *key, "edit_no", "e.*"
    )


def edit_steps(edits: DataFrame) -> DataFrame:
    """Edits as the steps a guard checks: action edit_file and what was applied."""
    return edits.withColumn("action_name", F.lit("edit_file")).withColumn(
        "args_key", F.to_json(F.struct("format", "path", "replace", "search"))
    ).withColumn(
        "tool_response", F.format_string("Applied %s edit to %s", "format", "path")
    )
