"""Quality rules by distribution divergence, in DataFrame functions only.

Every document gets base counts (words, symbols, repeated lines, repeated
three-word windows) and two histograms: character classes over the whole text
and the common words of each reference language. Both are compared by the
Jensen-Shannon distance (base 2, 0 to 1) with language references, which are
the pooled histograms of all documents of that language that have at least
``min_words`` words. A document is rejected when even the nearest language is
farther away than the limit. Guards: the character histogram is judged from
``min_chars`` characters on, the word histogram from ``min_words`` words on;
below that the distance is null and counts as passed.

Null and empty texts have no words: base_failed is true, both distances are
null. A language without references is left out; without any references the
method passes everything. An empty table gives no rows; very long texts are
counted whole, inside their row. Ties can't arise: rows don't compare with each
other. Repeated rows give repeated results. Columns other than the id, text and
language ones, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NON_SPACES, SPACES, materialise

# Common function words of the reference languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "by", "this", "are", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "dans", "pour", "sur", "par"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein"],
    "es": ["el", "los", "y", "las", "del", "se", "con", "una", "su", "al", "lo", "como", "no", "más", "o", "sus"],
}
# Character classes counted by pattern (what is to be taken out of a text to leave the class); spaces and the rest (lower-case and other letters) follow from the length.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "punct": "[^.,;:'\"?!()-]+", "symbol": r"[^#*$%&|<>=+@/\\^_~{}\[\]`]+"}
#: Lower-case letters, spaces and everything beyond ASCII: none of it is in a class above, and it is nearly all of a text.
PLAIN = r"[a-z\x20\x09-\x0D\x{80}-\x{10FFFF}]+"
ALL_WORDS = sorted({w for ws in COMMON_WORDS.values() for w in ws})
UNCOMMON = rf"(?<!{NON_SPACES})(?!(?:{'|'.join(ALL_WORDS)})(?:{SPACES}|\z)){NON_SPACES}+"
N_CLASSES = len(CLASSES) + 2


@dataclass(frozen=True)
class DivergenceRules:
    min_words: int = 50
    min_chars: int = 200
    max_char_distance: float = 0.22
    max_word_distance: float = 0.33
    max_repeat_percent: int = 50


def count_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """_id, _lang, the base counts and the two count arrays of every document; the texts stay behind."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.select(
        "*",
        F.array_remove(F.split("_text", SPACES + "+"), "").alias("_words"),
        F.regexp_replace("_text", PLAIN, "").alias("_marks"),
        # The common words alone, each between two spaces of its own; a word's count is then what its removal shortens the string by.
        F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(F.lower("_text"), UNCOMMON, ""), SPACES + "+", "  "), F.lit(" ")).alias("_common"),
    )
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(NON_SPACES))
    rows = rows.select(
        "_id", "_lang",
        F.size("_words").cast("long").alias("n_words"),
        F.length("_text").cast("long").alias("_chars"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_marks", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
        F.array(*[F.length(F.regexp_replace("_marks", pattern, "")).cast("long") for pattern in CLASSES.values()]).alias("_seen"),
        F.array(*[((F.length("_common") - F.length(F.replace("_common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("long") for w in ALL_WORDS]).alias("_counts"),
    )
    rest = F.col("word_chars") - F.aggregate("_seen", F.lit(0).cast("long"), lambda s, x: s + x)
    return rows.withColumn("_classes", F.concat("_seen", F.array(F.col("_chars") - F.col("word_chars"), rest))).drop("_seen")


def language_references(counted: DataFrame, rules: DivergenceRules = DivergenceRules()) -> dict[str, dict[str, list[float]]]:
    """Pooled histograms over all long enough documents of each reference language: at most one row per language reaches the driver."""
    rows = counted.filter(F.col("_lang").isin(list(COMMON_WORDS)) & (F.col("n_words") >= rules.min_words))
    got = rows.groupBy("_lang").agg(
        F.sum("n_words").alias("n"), F.sum("_chars").alias("chars"),
        *[F.sum(F.col("_classes")[k]).alias(f"c{k}") for k in range(N_CLASSES)],
        *[F.sum(F.col("_counts")[k]).alias(f"w{k}") for k in range(len(ALL_WORDS))],
    ).collect()
    out = {}
    for r in sorted(got, key=lambda r: r["_lang"]):
        own = [r[f"w{ALL_WORDS.index(w)}"] for w in COMMON_WORDS[r["_lang"]]]
        out[r["_lang"]] = {"classes": [r[f"c{k}"] / r["chars"] for k in range(N_CLASSES)], "words": [x / r["n"] for x in [*own, r["n"] - sum(own)]]}
    return out


def js_distance(own: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares from fixed shares."""
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    parts = F.zip_with(own, F.array(*[F.lit(float(x)) for x in reference]), lambda p, q: term(p, q) + term(q, p))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def repeated_words(words: Column) -> Column:
    """Words in three-word windows found twice or more.

    A text whose window hashes all differ has none. Otherwise the windows are
    sorted by hash with their positions, inside the row; neighbours of the same
    words are repeats, and the words they cover are counted once each.
    """
    at = lambda i, k: F.get(words, i + k)
    starts = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(starts, lambda i: F.xxhash64(at(i, 0), at(i, 1), at(i, 2)))

    def same(x: Column, y: Column) -> Column:
        return (x["h"] == y["h"]) & (at(x["i"], 0) == at(y["i"], 0)) & (at(x["i"], 1) == at(y["i"], 1)) & (at(x["i"], 2) == at(y["i"], 2))

    # One-element arrays bind a value to a name, so that it is computed once.
    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.get(F.transform(F.array(ordered), covered), F.lit(0)))

    return F.get(F.transform(F.array(hashes), count), F.lit(0)).cast("long")


def judge(counted: DataFrame, references: dict[str, dict[str, list[float]]], rules: DivergenceRules = DivergenceRules(), id_col: str = "doc_id") -> DataFrame:
    """One row per document: the base counts, both distances to the nearest language and the verdict."""
    share = lambda counts, total: F.transform(counts, lambda x: x.cast("double") / total)

    def word_shares(words: list[str]) -> Column:
        own = [F.col("_counts")[ALL_WORDS.index(w)] for w in words]
        return share(F.array(*own, F.col("n_words") - sum(own[1:], own[0])), F.col("n_words"))

    rows = counted.select(
        "*",
        F.when(F.col("_chars") > 0, share(F.col("_classes"), F.col("_chars"))).alias("_p"),
        *[F.when(F.col("n_words") > 0, word_shares(COMMON_WORDS[lang])).alias(f"_p_{lang}") for lang in references],
    )
    least = lambda xs: F.least(*xs) if len(xs) > 1 else xs[0] if xs else F.lit(None).cast("double")
    by_char = least([js_distance(F.col("_p"), r["classes"]) for r in references.values()])
    by_word = least([js_distance(F.col(f"_p_{lang}"), r["words"]) for lang, r in references.items()])
    rows = rows.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))).alias("base_failed"),
        F.when(F.col("_chars") >= rules.min_chars, F.round(by_char, 6)).alias("char_distance"),
        F.when(F.col("n_words") >= rules.min_words, F.round(by_word, 6)).alias("word_distance"),
    )
    passed = (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= rules.max_char_distance) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= rules.max_word_distance)
    return rows.withColumn("kept", ~F.col("base_failed") & passed)


def divergence_rules(docs: DataFrame, rules: DivergenceRules = DivergenceRules(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Every text is read once; its counts are written to the shared folder, pooled into references, then judged."""
    counted = materialise(count_documents(docs, id_col, text_col, lang_col), "divergence")
    return judge(counted, language_references(counted, rules), rules, id_col)
