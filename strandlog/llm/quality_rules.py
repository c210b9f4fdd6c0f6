"""Quality rules: lines are judged first, documents by what their lines lose.

Every line with a word is held against four rules, in this order:

* navigation: at least three bars `|`, one for every four words or more;
* punctuation: no word ends a sentence, or symbols make up more than a twentieth
  of the line, or it has capital letters but no small ones and three words or more;
* repetition: ten words or more of which over half equal the word before;
* boilerplate: at most 30 words and a licence, cookie or account phrase.

Lines that fail go. A document goes if its lines lose more than max_loss per cent
of its words, or if it fails the base counts (fewer than min_words words, or more
than max_repeat per cent of them inside repeated 3-word windows).

Everything is a DataFrame expression over one row: no shuffle and no Python. Windows
are compared by 64-bit hashes within one document; up to 2 ** POSITION_BITS windows by the 44 upper bits first and then in full, which
goes wrong only where three different windows of a document share those 44 bits. Very long texts are judged whole.

Null or empty text: no words, base_failed, not kept, cleaned text ''. Repeated rows
and ties: each row is judged alone. Empty table: empty result. Input columns stay as
they are; results are one struct column, in place of an input column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

SPACE = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
SENTENCE_END = r"""[.!?…][)"'”»\]]*([\x20\x09-\x0D]|$)"""
BOILERPLATE = (
    r"(?i)all rights reserved|licensed under|released under|cookie|privacy policy|terms of (use|service)"
    r"|enable javascript|subscribe to|sign (in|up)|log in|click here|read more|copyright|©"
)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


#: Bits of a position where it shares a 64-bit value with a hash; longer texts are sorted as structs.
POSITION_BITS = 20


def _repeated(hashes: Column, packed: Column, wide: Column) -> Column:
    """Sorted positions of windows whose hash stands twice or more.

    packed: sorted, the upper bits of each hash with its position in the lower bits, so that
    equal hashes are neighbours; the whole hashes decide, at up to two places either way,
    in case another hash shares the upper bits. wide: sorted structs h, i instead, for texts
    with more positions than the lower bits hold.
    """
    mask = F.lit((1 << POSITION_BITS) - 1)
    place = lambda x: x.bitwiseAND(mask).cast("int")
    near = lambda x, j, d: F.shiftright(x.bitwiseXOR(F.get(packed, j + d)), POSITION_BITS) == 0
    full = lambda x, j, d: F.coalesce(F.get(hashes, place(x)) == F.get(hashes, place(F.get(packed, j + d))), F.lit(False))
    same = F.filter(
        packed, lambda x, j: (near(x, j, -1) | near(x, j, 1)) & (full(x, j, -1) | full(x, j, 1) | full(x, j, -2) | full(x, j, 2))
    )
    long = F.filter(wide, lambda x, j: (x["h"] == F.get(wide, j - 1)["h"]) | (x["h"] == F.get(wide, j + 1)["h"]))
    return F.sort_array(F.coalesce(F.transform(same, place), F.transform(long, lambda x: x["i"])))


def line_rule(line: Column, words: Column, symbols: Column) -> Column:
    """Name of the first rule that a line fails, or null."""
    n = F.size(words)
    bars = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    again = F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
    return (
        F.when((symbols >= 3) & (bars >= 3) & (bars * 4 >= n), "navigation")
        .when(
            ~line.rlike(SENTENCE_END) | (symbols * 20 > F.length(line)) | ((n >= 3) & ~line.rlike(r"\p{Ll}") & line.rlike(r"\p{Lu}")),
            "punctuation",
        )
        .when((n >= 10) & (again * 2 > n), "repetition")
        .when((n <= 30) & line.rlike(BOILERPLATE), "boilerplate")
    )


def quality_rules(
    docs: DataFrame, text: str = "text", out: str = "quality", min_words: int = 50, max_repeat: int = 50, max_loss: int = 40
) -> DataFrame:
    """docs with a struct column out: counts, base_failed, kept, text after line cleaning.

    See the module for the rules and for nulls, ties and empty tables.
    """
    docs = docs.drop(out) if out != text else docs
    own = [docs[c].alias(f"_in{i}") for i, c in enumerate(docs.columns)]
    kept_columns = [f"_in{i}" for i in range(len(own))]
    staged = docs.select(*own, F.filter(F.split(F.coalesce(docs[text], F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_l"))
    # A line break is white space, so the words of the lines are the words of the text.
    staged = staged.withColumn("_lw", F.transform("_l", _words))
    line, words, v = F.col("_l"), F.col("_lw"), F.col("_v")
    symbols = lambda x: F.regexp_count(x, F.lit(SYMBOL))
    staged = staged.select(
        *kept_columns, "_l",
        F.flatten(words).alias("_w"),
        F.transform(
            F.transform(words, lambda ws, i: F.struct(ws.alias("ws"), F.get(line, i).alias("line"), symbols(F.get(line, i)).alias("symbols"))),
            lambda x: F.struct(F.size(x["ws"]).alias("n"), x["symbols"].alias("symbols"), line_rule(x["line"], x["ws"], x["symbols"]).alias("rule")),
        ).alias("_v"),
    )
    w, n = F.col("_w"), F.size("_w")
    staged = staged.select(
        *kept_columns, "_l", "_v",
        n.cast("long").alias("_n"),
        F.length(F.array_join(w, "")).cast("long").alias("_chars"),
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).alias("_h"),
    )
    h, few = F.col("_h"), F.size("_h") <= 1 << POSITION_BITS
    upper = F.lit(-1 << POSITION_BITS)
    staged = staged.withColumns({
        "_z": F.when(few, F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(upper).bitwiseOR(i.cast("long"))))),
        "_y": F.when(~few, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    })
    staged = staged.select(*kept_columns, "_l", "_v", "_n", "_chars", _repeated(h, F.col("_z"), F.col("_y")).alias("_p"))
    p = F.col("_p")
    total = lambda array, value: F.aggregate(array, F.lit(0), lambda a, x: a + value(x)).cast("long")
    covered = total(F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3)))), lambda x: x)
    staged = staged.select(
        *kept_columns, "_n", "_chars",
        total(v, lambda x: x["symbols"]).alias("_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("_dup"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("_repeat"),
        total(v, lambda x: F.when(x["rule"].isNull(), 0).otherwise(1)).alias("_failed"),
        total(v, lambda x: F.when(x["rule"].isNull(), 0).otherwise(x["n"])).alias("_lost"),
        F.array_join(F.filter(F.col("_l"), lambda x, i: F.get(v, i)["rule"].isNull()), "\n").alias("_text"),
    )
    base = (F.col("_n") < min_words) | (F.col("_repeat") * 100 > F.col("_n") * max_repeat)
    found = F.struct(
        F.col("_n").alias("n_words"),
        F.col("_chars").alias("word_chars"),
        F.col("_symbols").alias("n_symbols"),
        F.col("_dup").alias("n_dup_lines"),
        F.col("_repeat").alias("n_repeat_words"),
        F.col("_failed").alias("n_failed_lines"),
        F.col("_lost").alias("n_lost_words"),
        base.alias("base_failed"),
        (~base & (F.col("_lost") * 100 <= F.col("_n") * max_loss)).alias("kept"),
        F.col("_text").alias("text"),
    )
    return staged.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(docs.columns)], found.alias(out))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "n_lost_words"]
    return quality_rules(docs).select("doc_id", *[F.col("quality")[c].alias(c) for c in names])


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g),
p AS (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS n FROM c WHERE n > 1),
rep AS (SELECT r, sum(n) AS n_repeat_words FROM p GROUP BY r),
l AS (SELECT r, l FROM d, unnest(string_split(t, chr(10))) AS u(l) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
m AS (SELECT r, l, list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
f AS (SELECT r, l, len(ws) AS n,
  (len(l) - len(replace(l, '|', '')) >= 3 AND 4 * (len(l) - len(replace(l, '|', ''))) >= len(ws))
  OR NOT regexp_matches(l, '[.!?…][)"''”»\]]*([\x20\x09-\x0D]|$)')
  OR 20 * (len(l) - len(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > len(l)
  OR (len(ws) >= 3 AND regexp_matches(l, '\p{Lu}') AND NOT regexp_matches(l, '\p{Ll}'))
  OR (len(ws) >= 10 AND 2 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > len(ws))
  OR (len(ws) <= 30 AND regexp_matches(l, '(?i)all rights reserved|licensed under|released under|cookie|privacy policy|terms of (use|service)|enable javascript|subscribe to|sign (in|up)|log in|click here|read more|copyright|©')) AS bad
  FROM m),
s AS (SELECT r, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) FILTER (bad) AS n_failed_lines, coalesce(sum(n) FILTER (bad), 0) AS n_lost_words FROM f GROUP BY r),
a AS (SELECT doc_id, len(ws)::BIGINT AS n_words, len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(n_lost_words, 0)::BIGINT AS n_lost_words
  FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN s USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_lost_words <= 40 * n_words AS kept, n_failed_lines, n_lost_words
FROM a
"""
