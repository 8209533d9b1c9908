"""Quality rules by tokeniser fertility: how public vocabularies cut a text tells whether it is ordinary text of its language.

Two vocabularies, a byte-fallback one and a byte-level one, cut each word as it stands in running text. Measures of a
document: characters per token of each vocabulary, the share of tokens that stand for single bytes, and the entropy of its tokens relative
to the largest for their number. Bands come from all documents: the median of each measure and the median deviation from it, for each language (or script where
there is none) and class of length (words to a power of two), since short texts scatter more. A document is rejected when a measure is more
than ``width`` deviations from its median.

Words are runs of characters other than the six ASCII spaces. Null and empty texts have no words, fail the base rules and have null measures; repeated
rows each give a row.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
from public_tokenizers import PATTERN, path
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import CACHE_WORDS, map_texts, remembers, stored

PIECES, RANKS = path("piece_bpe_32k.model"), path("byte_bpe_multi_50k.tiktoken")
MEASURES = ("chars_per_piece", "chars_per_byte_token", "byte_share", "token_entropy")

#: Deviations from the median beyond which a document is rejected, and the least deviation of each measure; texts of fewer than
#: SETTLED words get more where fewer than FILLED documents make their band, by the square root of what is missing of either, whichever is less.
SETTLED, FILLED = 256, 64
WIDTH, LEAST = 6.0, {"chars_per_piece": 0.06, "chars_per_byte_token": 0.06, "byte_share": 0.02, "token_entropy": 0.02}

SYMBOLS = b"#*$%&|<>"

#: Marks a number in a row of piece ids as the other vocabulary's count of a word's tokens.
COUNT = 1 << 30


class FertilityCounter:
    """Measures texts; remembers each word's number and tokens."""

    def __init__(self, pieces: str, ranks: str):
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.number: dict[bytes, int] = {}
        self.tokens: list[bytes] = []

    def learn(self, words: set[bytes]) -> None:
        if len(self.number) > CACHE_WORDS:
            self.number.clear()
            self.tokens.clear()
        new = list(words.difference(self.number))
        texts = [w.decode() for w in new]
        for word, ids, other in zip(new, self.model.encode(texts, num_threads=1), map(self.ranks.encode_ordinary, [" " + t for t in texts]), strict=True):
            self.number[word] = len(self.tokens)
            self.tokens.append(np.array([*ids, COUNT + len(other)], "<u4").tobytes())

    def measure(self, body: bytes, words: list[bytes]) -> tuple:
        """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the four measures (None without words)."""
        lines = [x for x in body.split(b"\n") if x.strip()]
        symbols = sum(body.count(c) for c in [SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))])
        if not words:
            return (0, 0, symbols, 0, 0, None, None, None, None)
        numbers = np.array(list(map(self.number.__getitem__, words)))
        data = np.frombuffer(b"".join(map(self.tokens.__getitem__, numbers.tolist())), "<u4")
        counts = data >= COUNT
        ids = data[~counts]
        chars = sum(map(len, map(bytes.decode, words))) if not body.isascii() else sum(map(len, words))
        found = np.unique(ids, return_counts=True)[1] / max(1, len(ids))
        entropy = float(-(found * np.log(found)).sum() / np.log(len(ids))) if len(ids) > 1 else 1.0
        return (
            len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(numbers),
            chars / max(1, len(ids)), chars / max(1, int((data[counts] - COUNT).sum())), float(self.is_byte[ids].mean()) if len(ids) else 0.0, entropy,
        )


def repeated_words(numbers: np.ndarray, n: int = 5) -> int:
    """Words that lie in windows of n words found twice or more; exact, by numbering longer and longer windows."""
    if len(numbers) <= n:
        return 0
    key = np.unique(numbers, return_inverse=True)[1]
    kinds = single = int(key.max()) + 1
    words = key
    for k in range(1, n):
        key = key[:-1] * single + words[k:]
        kinds *= single
        if kinds * single >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            kinds = int(key.max()) + 1
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(numbers) + 1, np.int64)
    starts = np.flatnonzero(times[at] > 1)
    edge[starts] += 1
    np.subtract.at(edge, starts + n, 1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


@lru_cache(2)
def _worker(pieces: str, ranks: str) -> FertilityCounter:
    return FertilityCounter(pieces, ranks)


remembers(__name__, _worker.cache_clear)


def fertility(docs: DataFrame, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """doc_id, language, the base counts and the measures of each whole text."""
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *MEASURES)

    def make():
        counter = _worker(pieces, ranks)

        def work(cols):
            bodies = [(t or "").encode() for t in cols["text"]]
            words = [b.split() for b in bodies]
            counter.learn({w for x in words for w in x})
            rows = [counter.measure(b, w) for b, w in zip(bodies, words, strict=True)]
            return {"doc_id": cols["doc_id"], "language": cols["language"]} | {c: [r[k] for r in rows] for k, c in enumerate(columns)}

        return work

    schema = "doc_id bigint, language string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, " + ", ".join(f"{m} double" for m in MEASURES)
    return map_texts(docs.select("doc_id", "text", language_of(docs).alias("language")), schema, make)


def language_of(docs: DataFrame) -> Column:
    """The column lang where there is one, else the script of the first letter."""
    letter = F.regexp_extract("text", r"\p{L}", 0)
    script = F.coalesce(*[F.when(letter.rlike(rf"\p{{Is{s}}}"), s) for s in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai")], F.lit("other"))
    return F.coalesce(F.col("lang"), script) if "lang" in docs.columns else script


def bands(measured: DataFrame) -> DataFrame:
    """By language and size class: number of the documents that pass the base rules, and median and deviation of each measure over them all."""
    group, usable = ["language", "size_class"], measured.filter(~F.col("base_failed"))
    middle = usable.groupBy(*group).agg(F.count("*").alias("n_docs"), *[F.percentile_approx(m, 0.5, 10000).alias(f"{m}_mid") for m in MEASURES])
    away = usable.join(middle, group).select(*group, *[F.abs(F.col(m) - F.col(f"{m}_mid")).alias(m) for m in MEASURES])
    return middle.join(away.groupBy(*group).agg(*[F.percentile_approx(m, 0.5, 10000).alias(f"{m}_off") for m in MEASURES]), group)


def quality_rules(docs: DataFrame, width: float = WIDTH, pieces: str = PIECES, ranks: str = RANKS) -> DataFrame:
    """doc_id, base counts, base_failed, kept, rejected_by (measures out of their bands, comma-joined) and the measures of each document."""
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    measured = stored(fertility(docs, pieces, ranks).withColumn("base_failed", (n < 10) | (100 * repeats > 20 * n)).withColumn("size_class", F.floor(F.log2(F.greatest(n, F.lit(1)))).cast("int")))
    wider = F.greatest(F.lit(1.0), F.least(F.sqrt(SETTLED / F.greatest(n, F.lit(1))), F.sqrt(FILLED / F.col("n_docs"))))
    outside = [F.when(F.abs(F.col(m) - F.col(f"{m}_mid")) > width * F.greatest(F.col(f"{m}_off"), LEAST[m] * wider), m) for m in MEASURES]
    judged = measured.join(bands(measured), ["language", "size_class"], "left").withColumn("rejected_by", F.concat_ws(",", *outside))
    kept = ~F.col("base_failed") & (F.col("rejected_by") == "")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "rejected_by", "language", *MEASURES)
