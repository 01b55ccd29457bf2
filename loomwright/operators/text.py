"""Text and text-pair features, TF-IDF tables and turn lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.expr import col, row_count, safe_div
from loomwright.functions.text import (
    BULLET, FENCE, HASHTAG, HEADER, MENTION, URL, WORD, clean_full, clean_light, count_of, squeeze, strip_accents,
    url_unquote, words,
)
from loomwright.operators.lowrank import SparseTable, Svd
from loomwright.operators.term_blocks import TermBlocks
from loomwright.plans.quantile import column_quantiles
from loomwright.plans.store import cut

# fixed values: turn separator, field marks and prompt lines
TURN_SEPARATOR = "\n\n"
FIELD_MARKS = ("Prompt: ", "Response A: ", "Response B: ")
PROMPT_LINES = ("Keyword: ", "Tweet: ", "\nAnswer (1 or 0):")
PADDING = " "


def build_field(text, keyword=None, light: bool = False) -> Column:
    """Decoded keyword before the cleaned text, whitespace squeezed."""
    cleaned = clean_light(text) if light else clean_full(text)
    return cleaned if keyword is None else squeeze(F.concat_ws(" ", url_unquote(keyword), cleaned))


def counts(text: str) -> dict[str, Column]:
    return {
        "char_len": F.length(text), "word_len": F.size(words(text)), "n_url": count_of(text, URL),
        "n_mention": count_of(text, MENTION), "n_hashtag": count_of(text, HASHTAG), "n_exclaim": count_of(text, "!"),
    }


def markers(text: str) -> dict[str, Column]:
    """Layout descriptors of one side of a conversation."""
    n_char, n_word = F.length(text), count_of(text, " ") + 1
    return {
        "char": n_char, "word": n_word, "avg_word": n_char / F.greatest(n_word, F.lit(1)), "newline": count_of(text, r"\n"),
        "code": F.floor(count_of(text, FENCE) / 2).cast("int"), "bullet": count_of(text, BULLET), "header": count_of(text, HEADER),
        "digit": count_of(text, r"\p{Nd}"),
    }


def pair_features(df: DataFrame, a: str, b: str, keep: Sequence[str]) -> DataFrame:
    """Differences and bounded ratios of the two sides' descriptors."""
    ma, mb = markers(a), markers(b)
    wide = df.select(*keep, *[e.alias(f"a_{n}") for n, e in ma.items()], *[e.alias(f"b_{n}") for n, e in mb.items()])
    return wide.select(*keep, *[(F.col(f"a_{n}") - F.col(f"b_{n}")).alias(f"diff_{n}") for n in ma],
                       *[safe_div(f"a_{n}", F.greatest(F.col(f"b_{n}"), F.lit(1))).alias(f"ratio_{n}") for n in ma])


def split_parts(text, sep: str, names: Sequence[str]) -> dict[str, Column]:
    parts = F.split(col(text), sep)
    return {n: F.get(parts, F.lit(i)) for i, n in enumerate(names)}


def last_part(text, pattern: str) -> Column:
    return F.element_at(F.split(col(text), pattern), -1)


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.explode(words(F.lower(F.col(text)))).alias("token")).distinct()


def vocab_overlap(train: DataFrame, test: DataFrame, text: str) -> DataFrame:
    """Test tokens, and how many of them the training texts never use."""
    known = vocabulary(train, text).withColumn("__known", F.lit(1))
    j = vocabulary(test, text).join(known, "token", "left")
    unseen = F.count_if(F.col("__known").isNull())
    return j.agg(row_count().alias("n_tokens"), unseen.alias("n_unseen"), (unseen / row_count()).alias("unseen_share"))


# ---- TF-IDF ------------------------------------------------------------------------------------


def bigrams(w: Column) -> Column:
    """Neighbouring words joined by a space, as a zip of the list with its own tail."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def word_counts(df: DataFrame, id_col: str, text: str, accents: bool = True) -> DataFrame:
    """Term counts of lower-cased word unigrams and bigrams per document."""
    t = F.lower(F.col(text))
    w = df.select(id_col, F.regexp_extract_all(strip_accents(t) if accents else t, F.lit(WORD), F.lit(0)).alias("w"))
    terms = w.select(id_col, F.explode(F.concat(F.col("w"), bigrams(F.col("w")))).alias("term"))
    return terms.groupBy(id_col, "term").agg(row_count().alias("tf"))


def char_counts(df: DataFrame, id_col: str, text: str, low: int = 3, high: int = 5) -> DataFrame:
    """Character n-grams inside padded words; equal words of a text are counted before they are cut up."""
    tok = df.select(id_col, F.explode(words(F.lower(F.col(text)))).alias("t")).groupBy(id_col, "t").agg(row_count().alias("n"))
    padded = tok.select(id_col, "n", F.concat(F.lit(PADDING), "t", F.lit(PADDING)).alias("w"))

    def pieces_of(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length("w") - size + 1, F.lit(1)))
        pieces = F.transform(starts, lambda i: F.substring(F.col("w"), i, F.lit(size)))
        return F.when(F.length("w") >= size, pieces).otherwise(F.array().cast("array<string>"))

    grams = [pieces_of(n) for n in range(low, high + 1)]
    g = padded.select(id_col, "n", F.explode(F.concat(*grams)).alias("term"))
    return g.groupBy(id_col, "term").agg(F.sum("n").alias("tf"))


def document_frequency(tf: DataFrame, min_df: int, max_features: int | None = None) -> DataFrame:
    """Terms in at least ``min_df`` documents; with ``max_features`` the most frequent ones overall."""
    per = tf.groupBy("term").agg(row_count().alias("df"), F.sum("tf").alias("total")).filter(F.col("df") >= min_df)
    if max_features is None:
        return per.select("term", "df")
    # max_features bounds the vocabulary, so this is an ordinary top-n
    return per.orderBy(F.desc("total"), "term").limit(max_features).select("term", "df")


def tfidf(tf: DataFrame, df_table: DataFrame, id_col: str, n_docs: int) -> DataFrame:
    """(1 + ln tf) * (ln((1+n)/(1+df)) + 1), each document scaled to unit length: (id, term, weight)."""
    raw = tf.join(df_table, "term").select(
        id_col, "term", ((1 + F.log("tf")) * (F.log(F.lit(1.0 + n_docs) / (1 + F.col("df"))) + 1)).alias("w"))
    # the window holds the distinct terms of one document, which was one input row
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return raw.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def svd_embed(table: SparseTable, id_col: str, k: int, **search) -> DataFrame:
    """Uncentred truncated SVD of the TF-IDF rows, projected and scaled to unit length: (id, v array)."""
    return Svd(table, k=k, **search).scores().select(F.col("id").alias(id_col), unit(F.col("v")).alias("v"))


def pair_block(pairs: DataFrame, id_col: str, k: int, min_df: int = 3, **search) -> DataFrame:
    """Embeddings of a prompt ``p`` and two answers ``a``, ``b``: (id, a, b, d = a - b, p, cos_ab, cos_pa, cos_pb).

    Vocabulary, document frequencies and the answers' SVD come from both answers together, the prompts have an SVD of
    their own over the same terms. A text without known terms is the zero vector, its cosines are NULL.
    """
    sides = [pairs.select(F.col(id_col).alias("id"), F.lit(s).alias("side"), F.coalesce(F.col(s), F.lit("")).alias("text")) for s in ("a", "b", "p")]
    texts = cut(sides[0].unionByName(sides[1]).unionByName(sides[2]).withColumns(
        {"key": F.concat_ws(":", "side", "id"), "prompt": (F.col("side") == "p").cast("int")}))
    answers, prompts = TermBlocks(texts, "key", "text", ["word"], ["prompt"]).tables(min_df, "prompt")
    both = svd_embed(answers, "key", k, **search).unionByName(svd_embed(prompts, "key", k, **search))
    # a vector goes to its pair's row by its key alone, so it is dealt once; ids of pairs without any come from the texts
    nothing = F.lit(None).cast("array<double>").alias("v")
    keyed = texts.filter("side = 'a'").select("id", "key", nothing).unionByName(both.select("key", "v"), allowMissingColumns=True)
    mine = F.substring("key", 1, 1)
    rows = keyed.groupBy(F.expr("substring(key, 2)").alias("__own")).agg(
        F.first("id", True).alias("id"), *[F.first(F.when(mine == s, F.col("v")), True).alias(s) for s in ("a", "b", "p")])
    zero = F.array_repeat(F.lit(0.0), k)
    full = rows.select("id", *[F.coalesce(F.when(F.size(s) == k, F.col(s)), zero).alias(s) for s in ("a", "b", "p")])
    return full.select(F.col("id").alias(id_col), "a", "b", vector_difference("a", "b").alias("d"), "p",
                       cosine("a", "b").alias("cos_ab"), cosine("p", "a").alias("cos_pa"), cosine("p", "b").alias("cos_pb"))


# ---- vectors -----------------------------------------------------------------------------------


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a) -> Column:
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.try_divide(x, size))


def cosine(a, b) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_difference(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x.cast("double") - y.cast("double"))


# ---- turns, budgets, prompts -------------------------------------------------------------------


def parse_turns(cell) -> Column:
    """JSON list of strings; another JSON value or a broken cell becomes one turn, non-strings ''."""
    c = col(cell)
    v = F.try_parse_json(c)
    is_list = F.schema_of_variant(v).startswith("ARRAY")
    cells = F.try_variant_get(v, "$", "array<variant>")

    def turn(x: Column) -> Column:
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")).otherwise(F.lit(""))

    # a bare JSON string is unquoted, any other value keeps its text
    scalar = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(c)
    return F.when(v.isNotNull() & is_list, F.coalesce(F.transform(cells, turn), F.array().cast("array<string>"))).otherwise(F.array(scalar))


def join_turns(turns) -> Column:
    return F.array_join(col(turns), TURN_SEPARATOR)


def head_tail(tokens: Column, budget: int) -> Column:
    """At most ``budget`` tokens: the first half of the budget, and what follows the gap that the rest leaves."""
    half = budget // 2
    resume = F.greatest(F.lit(half), F.size(tokens) - (budget - half))
    return F.concat(F.slice(tokens, 1, half), F.slice(tokens, resume + 1, F.lit(budget - half)))


def allotted(room: int, shares: Sequence[int]) -> list[int]:
    """Places of each field by whole shares of the room, rounded down."""
    return [room * s // sum(shares) for s in shares]


@dataclass(frozen=True)
class Field:
    """A field of a packed sequence: the mark before it, its text and its share of the room."""

    mark: str
    text: Column
    share: int


def assemble(fields: Sequence[Field], max_len: int, opening: str = "[CLS]", closing: str = "[SEP]") -> Column:
    """Opening token, then every field cut to its share of the room and followed by the closing token."""
    room = max_len - 1 - len(fields)
    pieces = [F.array(F.lit(opening))]
    for field, budget in zip(fields, allotted(room, [f.share for f in fields])):
        pieces += [head_tail(words(F.concat(F.lit(field.mark), field.text)), budget), F.array(F.lit(closing))]
    return F.concat(*pieces)


#: fixed values: rules for reading a 0/1 reply, first match wins: (kind, pattern or key words, label)
REPLY_RULES = (
    ("first", r'"?label"?\s*[:=]\s*([01])', None),
    ("last", r"\b([01])\b", None),
    ("any", ("not", "non-disaster", "no disaster"), 0),
    ("any", ("disaster", "real"), 1),
)


def parse_label(reply, rules=REPLY_RULES) -> Column:
    """0/1 from a free reply by the first rule that says something, else NULL."""
    said = F.trim(col(reply))

    def read(kind: str, what, label) -> Column:
        if kind == "any":
            return F.when(reduce(or_, [F.contains(F.lower(said), F.lit(w)) for w in what]), F.lit(label))
        found = F.regexp_extract_all(said, F.lit(what), F.lit(1))
        return F.try_element_at(found, F.lit(1 if kind == "first" else -1)).try_cast("int")

    return F.coalesce(*[read(*rule) for rule in rules])


def prompt_message(keyword, text) -> Column:
    k = F.replace(F.coalesce(col(keyword), F.lit("")), F.lit("%20"), F.lit(" "))
    head = F.when(k != "", F.concat(F.lit(PROMPT_LINES[0]), k, F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(head, F.lit(PROMPT_LINES[1]), col(text), F.lit(PROMPT_LINES[2]))


def token_budget(df: DataFrame, text: str, probs: Sequence[float]) -> DataFrame:
    """Quantiles of the characters / 4 token estimate."""
    sized = df.select((F.length(text) / 4.0).alias("tokens"))
    q = column_quantiles(sized, ["tokens"], probs)["tokens"]
    out = sized.agg(F.avg("tokens").alias("mean"), F.max("tokens").alias("max"))
    return out.select("mean", "max", *[F.lit(v).alias(f"q{int(p * 100)}") for p, v in zip(probs, q)])
