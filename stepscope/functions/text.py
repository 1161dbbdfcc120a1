"""Column expressions on text: cleaning, tokens, redaction, word rules."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepscope import taxonomy as tx


def strip(col: Column) -> Column:
    """Trim white space of any kind; built-in trim only knows the blank."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(strip(col)) > 0, col)


def let(col: Column, use) -> Column:
    """Name a sub-expression so that it is written and evaluated once."""
    return F.element_at(F.transform(F.array(col), use), 1)


def tokens(col: Column, stopwords: list[str] | None = None) -> Column:
    """Lower-case words of [a-z0-9_], longer than one character, no stopwords."""
    words = F.regexp_extract_all(F.lower(col), F.lit(r"[a-z0-9_]+"), F.lit(0))
    drop = tx.STOPWORDS if stopwords is None else stopwords
    return F.filter(
        F.coalesce(words, F.array().cast("array<string>")),
        lambda w: (F.length(w) > 1) & ~w.isin(*drop) if drop else F.length(w) > 1,
    )


def contains_any(col: Column, words: list[str]) -> Column:
    """True when any of the words is a substring; null text counts as empty."""
    text = F.coalesce(col, F.lit(""))
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def first_contained(col: Column, words: list[str]) -> Column:
    """The first word of the list that occurs as a substring, else null."""
    return F.coalesce(*[F.when(col.contains(w), F.lit(w)) for w in words])


def redact(col: Column, extra: list[tuple[str, str]] = ()) -> Column:
    """Mask credentials; `extra` adds (pattern, replacement) after the standard ones."""
    for pattern, replacement in [*tx.CREDENTIALS, *extra]:
        col = F.regexp_replace(col, pattern, replacement)
    return col


def _redact_typed(col: Column, kind: T.DataType, extra) -> Column:
    if isinstance(kind, T.StringType):
        return redact(col, extra)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _redact_typed(x, kind.elementType, extra))
    if isinstance(kind, T.MapType):
        return F.transform_values(col, lambda k, v: _redact_typed(v, kind.valueType, extra))
    if isinstance(kind, T.StructType):
        fields = [
            _redact_typed(col[f.name], f.dataType, extra).alias(f.name) for f in kind.fields
        ]
        return F.when(col.isNotNull(), F.struct(*fields))
    return col


def _holds_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return True
    if isinstance(kind, T.ArrayType):
        return _holds_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_text(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_text(f.dataType) for f in kind.fields)
    return False


def redact_frame(df: DataFrame, extra: list[tuple[str, str]] = ()) -> DataFrame:
    """Mask credentials in every string of the frame, at any depth."""
    return df.select(
        *[
            _redact_typed(F.col(f"`{f.name}`"), f.dataType, extra).alias(f.name)
            if _holds_text(f.dataType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def iso_epoch(col: Column) -> Column:
    """ISO time to epoch seconds; null when it is not one."""
    stamp = F.try_to_timestamp(F.regexp_replace(col, "Z", "+00:00"))
    return F.unix_micros(stamp) / F.lit(1e6)


def canonical_json(col: Column) -> Column:
    """JSON text with sorted keys, so that equal arguments compare equal."""
    return F.coalesce(F.to_json(F.try_parse_json(col)), col)


def map_key(col: Column) -> Column:
    """A map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(col))))


def parse_args(col: Column) -> Column:
    """Call arguments as a map: an object as it is, other JSON as `args`, text as `raw`."""
    text = F.coalesce(col, F.lit(""))
    value = F.try_parse_json(text)
    kind = F.schema_of_variant(value)
    as_map = F.from_json(text, "map<string,string>")
    return (
        F.when(col.isNull(), F.create_map().cast("map<string,string>"))
        .when(value.isNull(), F.create_map(F.lit("raw"), text))
        .when(kind.startswith("OBJECT"), as_map)
        .otherwise(F.create_map(F.lit("args"), F.to_json(value)))
    )


def failure_term(col: Column) -> Column:
    """The words that show a failed tool call, or null; benign uses do not count."""
    found = [F.nullif(F.regexp_extract(col, p, 0), F.lit("")) for p in tx.FAILURE_PHRASES]
    rest = col
    for pattern in tx.BENIGN_PHRASES:
        rest = F.regexp_replace(rest, pattern, " ")
    found.append(F.nullif(F.regexp_extract(rest, tx.FAILURE_WORD, 0), F.lit("")))
    return F.coalesce(*found)


def success_phrase(col: Column) -> Column:
    """The first success phrase of a tool response; "found" must be meant so."""
    low = F.lower(F.coalesce(col, F.lit("")))
    tests = []
    for phrase in tx.SUCCESS_PHRASES:
        hit = low.contains(phrase)
        if phrase == "found":
            hit = hit & ~low.rlike(tx.NOT_FOUND) & low.rlike(tx.FOUND)
        tests.append(F.when(hit, F.lit(phrase)))
    return F.coalesce(*tests)


def response_failed(col: Column) -> Column:
    return contains_any(F.lower(col), tx.RESPONSE_ERRORS)


MATCH = (
    "struct<category:string,confidence:double,layer:string,pattern_id:string,"
    "rule_id:string,description:string,safe_alternative:string>"
)


def match_struct(
    category, confidence, layer, pattern_id="", rule_id="", description="", safe_alternative=""
) -> Column:
    def c(x):
        return x if isinstance(x, Column) else F.lit(x)

    return F.struct(
        c(category).alias("category"),
        c(confidence).cast("double").alias("confidence"),
        c(layer).alias("layer"),
        c(pattern_id).alias("pattern_id"),
        c(rule_id).alias("rule_id"),
        c(description).alias("description"),
        c(safe_alternative).alias("safe_alternative"),
    )


def sql_text(value: str) -> str:
    """A string as an SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array_sql(values) -> str:
    return f"array({', '.join(values)})"


def rule_sets_sql(rules) -> str:
    """The word sets of all rules as one SQL literal: rules, sets, words."""
    return _array_sql(
        _array_sql(_array_sql(map(sql_text, words)) for words in sets)
        for _, _, _, sets in rules
    )


def _cover(sets: list) -> list[str]:
    """Few words of which every set holds one; all sets must hold a word."""
    left, chosen = [set(words) for words in sets], []
    while left:
        count = Counter(w for words in left for w in words)
        chosen.append(max(sorted(count), key=count.get))
        left = [words for words in left if chosen[-1] not in words]
    return chosen


def _may_hit_sql(rules) -> str:
    """False for texts that hold too few words of the rules for any word set, as most do."""
    sets = [set(words) for _, _, _, sets in rules for words in sets]
    if not all(sets):
        return "true"

    def listed(words) -> str:
        return f"cast({_array_sql(map(sql_text, sorted(words)))} as array<string>)"

    alone = set().union(*[words for words in sets if len(words) == 1])
    return (
        f"exists({listed(_cover(sets))}, w -> contains(low, w)) and "
        f"(exists({listed(alone)}, w -> contains(low, w)) or "
        f"size(filter({listed(set().union(*sets))}, w -> contains(low, w))) > 1)"
    )


def add_keyword_rule(df: DataFrame, out: str, text_sql: str, rules=None) -> DataFrame:
    """Add the rule with most hit word sets (the earlier one on ties) as a match struct.

    `text_sql` is the text as an SQL expression. The rules are data to one small
    expression: written out as code they make a method too large for the JIT, which
    measured almost three times slower.
    """
    rules = tx.KEYWORD_RULES if rules is None else rules

    def pick(values) -> str:
        return f"get({_array_sql(values)}, array_position(_hits, array_max(_hits)) - 1)"

    share = f"array_max(_hits) / {pick(f'{len(r[3])}D' for r in rules)}"
    fields = {
        "category": pick(sql_text(r[1]) for r in rules),
        "confidence": f"round(least(0.85D, 0.40D + {share} * 0.45D), 4)",
        "layer": "'keyword'",
        "pattern_id": "''",
        "rule_id": pick(sql_text(r[0]) for r in rules),
        "description": pick(sql_text(r[2]) for r in rules),
        "safe_alternative": "''",
    }
    body = ", ".join(f"'{name}', {value}" for name, value in fields.items())
    # The lower-cased text is bound by an outer lambda; as a column the optimizer
    # would put it back into the inner one and lower it once per word.
    hits = (
        f"transform(array(lower(coalesce({text_sql}, ''))), low -> "
        f"if({_may_hit_sql(rules)}, transform({rule_sets_sql(rules)}, rule -> "
        "cast(size(filter(rule, words -> forall(words, w -> contains(low, w)))) AS int)), null))[0]"
    )
    return (
        df.withColumn("_hits", F.expr(hits))
        .withColumn(out, F.expr(f"if(array_max(_hits) > 0, named_struct({body}), null)"))
        .drop("_hits")
    )
