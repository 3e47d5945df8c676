"""Byte-level BPE in DuckDB: a recursive query per batch of distinct words, an ordered aggregation to decode.

Each Spark task cuts its texts into the pattern's matches and keeps a bounded memory of words it
has coded. New words become token-position rows of an in-process DuckDB table; the recursive
query joins neighbours with the merge table and contracts each word's leftmost pair of minimum
rank until no word has a pair left. Decoding joins ids with the vocabulary and aggregates their
bytes in order.

A long word is coded in blocks, so that the work grows with its length and not with its square.
Two codes may be joined as they are where the last token of one and the first of the other, coded
together, stay apart: no merge of the whole word crosses that place then, since the first to do so
would be the least pair of these two tokens' bytes as well. Otherwise the tokens around the place
are coded anew, and the result is taken where it begins and ends with a token that was there before.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words a worker remembers at most between groups of texts.
MEMORY_WORDS = 600_000

#: Words coded by one query, and tokens decoded by one, to bound DuckDB's memory.
WORDS_AT_ONCE, TOKENS_AT_ONCE = 60_000, 2_000_000
#: Bytes from which a word is coded in blocks, and the bytes of a block.
LONG, BLOCK = 512, 128

# A row is a token: its word's number and its place in the word are the halves of wp, and key is the
# rank of the pair that it starts, above its place. So the least key of a word is its leftmost pair of
# minimum rank. That row takes the merged id, the row after it goes and the later ones move up; the
# word's rows then look up their pairs anew. A word without pairs leaves with done set.
_ENCODE = """
WITH RECURSIVE
first AS MATERIALIZED (SELECT word::BIGINT * 4294967296 + pos AS wp, id FROM start),
state(wp, id, key, done) AS (
    SELECT a.wp, a.id, rank::BIGINT * 4294967296 + (a.wp & 4294967295), false
    FROM first a LEFT JOIN first b ON b.wp = a.wp + 1 LEFT JOIN merges ON pair = a.id::BIGINT * 4294967296 + b.id
  UNION ALL
    (WITH best AS (SELECT wp >> 32 AS word, min(key) AS best, min(key) & 4294967295 AS place FROM state WHERE NOT done GROUP BY 1),
    cut AS MATERIALIZED (
        SELECT CASE WHEN key = best THEN (best >> 32)::INTEGER ELSE id END AS id, wp - CASE WHEN (wp & 4294967295) > place THEN 1 ELSE 0 END AS wp, best
        FROM state JOIN best ON word = wp >> 32
        WHERE NOT done AND (best IS NULL OR (wp & 4294967295) <> place + 1))
    SELECT a.wp, a.id, rank::BIGINT * 4294967296 + (a.wp & 4294967295), a.best IS NULL
    FROM cut a LEFT JOIN cut b ON b.wp = a.wp + 1 AND a.best IS NOT NULL LEFT JOIN merges ON pair = a.id::BIGINT * 4294967296 + b.id)
)
SELECT (wp >> 32)::INTEGER AS word, id FROM state WHERE done ORDER BY wp
"""
_DECODE = "SELECT text, string_agg(piece, '' ORDER BY pos) AS decoded FROM ids JOIN vocabulary USING (id) GROUP BY text ORDER BY text"


class Coder:
    """Encode words and decode ids with one vocabulary of ranks in an own DuckDB database."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for whole, r in ranks.items():
            for k in range(1, len(whole)):
                if (a := ranks.get(whole[:k])) is not None and (b := ranks.get(whole[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        merges = pa.table({"left_id": pa.array(left, pa.int32()), "right_id": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())})
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE merges AS SELECT left_id::BIGINT * 4294967296 + right_id AS pair, rank FROM merges_in")
        # bytes travel as the code points of the same numbers, which an ordered string_agg can join
        vocabulary = pa.table({"id": pa.array(list(self.bytes_of), pa.int32()), "piece": [b.decode("latin-1") for b in self.bytes_of.values()]})
        self.db.register("vocabulary_in", vocabulary)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word; an empty word has none."""
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        if long:
            short = self.encode_words([b"" if len(w) > LONG else w for w in words])
            for i, ids in zip(long, self._encode_long([words[i] for i in long]), strict=True):
                short[i] = ids
            return short
        out: list[np.ndarray] = []
        for i in range(0, len(words), WORDS_AT_ONCE):
            out += self._encode(words[i : i + WORDS_AT_ONCE])
        return out

    def _whole(self, words: list[bytes]) -> list[list[int]]:
        """Codes of the words, equal ones coded once."""
        distinct = list(dict.fromkeys(words))
        ids = dict(zip(distinct, (x.tolist() for i in range(0, len(distinct), WORDS_AT_ONCE) for x in self._encode(distinct[i : i + WORDS_AT_ONCE])), strict=True))
        return [ids[w] for w in words]

    def _encode_long(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of long words, by blocks."""
        blocks = [[w[i : i + BLOCK] for i in range(0, len(w), BLOCK)] for w in words]
        ids = iter(self._whole([b for word in blocks for b in word]))
        codes = [[next(ids) for _ in word] for word in blocks]
        while True:
            open_ = [(w, j) for w, word in enumerate(codes) for j in range(len(word) - 1)]
            seams: dict[tuple[int, int], tuple[int, list[int]]] = {}
            reach = 1
            while open_:
                # a block keeps a token that neither of its ends' seams replaces
                tried = [(w, j) for w, j in open_ if reach - 1 <= min(len(codes[w][j]) - 1, len(codes[w][j + 1]) - 1) // 2]
                around = [(codes[w][j][-reach:], codes[w][j + 1][:reach]) for w, j in tried]
                again = self._whole([b"".join(self.bytes_of[i] for i in left + right) for left, right in around])
                seams |= {at: (reach, new) for at, (left, right), new in zip(tried, around, again, strict=True) if len(new) > 1 and new[0] == left[0] and new[-1] == right[-1]}
                open_ = [at for at in tried if at not in seams]
                reach *= 2
            failed = [[j for j in range(len(word) - 1) if (w, j) not in seams] for w, word in enumerate(codes)]
            if not any(failed):
                return [self._joined(word, [seams[w, j] for j in range(len(word) - 1)]) for w, word in enumerate(codes)]
            # blocks on both sides of a place without a seam become one
            for w, places in enumerate(failed):
                for j in reversed(places):
                    blocks[w][j : j + 2] = [blocks[w][j] + blocks[w][j + 1]]
                    codes[w][j : j + 2] = [[]]
            todo = [(w, j) for w, word in enumerate(codes) for j, ids in enumerate(word) if not ids]
            for (w, j), new in zip(todo, self._whole([blocks[w][j] for w, j in todo]), strict=True):
                codes[w][j] = new

    @staticmethod
    def _joined(word: list[list[int]], seams: list[tuple[int, list[int]]]) -> np.ndarray:
        """A word's blocks with each seam's tokens in place of those around it, its first and last being the blocks' own."""
        out: list[int] = []
        begin = 0
        for block, (reach, new) in zip(word, seams, strict=False):
            out += block[begin : len(block) - reach + 1]
            out += new[1:-1]
            begin = reach - 1
        return np.array(out + word[-1][begin:], np.int32)

    def _encode(self, words: list[bytes]) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        starts = np.cumsum(sizes) - sizes
        start = pa.table({
            "word": pa.array(word, pa.int32()),
            "pos": pa.array(np.arange(len(word)) - starts[word], pa.int32()),
            "id": pa.array(self.byte_id[np.frombuffer(b"".join(words), np.uint8)], pa.int32()),
        })
        self.db.register("start", start)
        done = self.db.execute(_ENCODE).fetchnumpy()
        self.db.unregister("start")
        ends = np.searchsorted(done["word"], np.arange(1, len(words)))
        return np.split(np.asarray(done["id"], np.int32), ends)

    def decode(self, texts: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id sequence."""
        out, first = [b""] * len(texts), 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= TOKENS_AT_ONCE):
                size += len(texts[last])
                last += 1
            sizes = [len(t) for t in texts[first:last]]
            ids = pa.table({"text": pa.array(np.repeat(np.arange(first, last), sizes), pa.int32()), "pos": pa.array(np.arange(size), pa.int32()), "id": pa.array(np.concatenate(texts[first:last]), pa.int32())})
            self.db.register("ids", ids)
            for text, decoded in self.db.execute(_DECODE).fetchall():
                out[text] = decoded.encode("latin-1")
            self.db.unregister("ids")
            first = last
        return out


# White space as Unicode defines it, which is what the pattern's \\s means to the tokenizer library.
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Texts of Basic Latin to Latin Extended-B without other numbers than digits: there the two patterns agree.
_PLAIN = re.compile("[\\x00-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]*")
_PLAIN_PATTERN = re.compile(rf" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^{_SPACE}\w]|_)+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def splitter(pattern: str):
    """text -> its matches. The usual pattern has a faster equal for Latin texts."""
    import regex

    whole = regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"(?!\S)", f"(?![^{_SPACE}])").replace(r"\s+", f"[{_SPACE}]+"))
    usual = pattern == r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return lambda text: _PLAIN_PATTERN.findall(text) if usual and _PLAIN.fullmatch(text) else whole.findall(text)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Numbers(dict):
    """word -> its number, in order of first sight; the new ones wait in ``fresh``."""

    def __init__(self, words=()):
        super().__init__(zip(words, range(len(words)), strict=True))
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number


class Vocabulary:
    """A coder with its memory of words; one per worker process and file.

    The memory is one array of all remembered words' ids with each word's start and length, so
    that texts turn into ids by array lookups.
    """

    held: dict[tuple[str, str], "Vocabulary"] = {}

    def __init__(self, path: str, pattern: str):
        self.coder, self.split = Coder(load_ranks(path)), splitter(pattern)
        self.numbers = _Numbers()
        self.pool, self.size = np.empty(0, np.int32), np.empty(0, np.int64)

    @classmethod
    def of(cls, path: str, pattern: str) -> "Vocabulary":
        if (path, pattern) not in cls.held:
            cls.held[path, pattern] = cls(path, pattern)
        return cls.held[path, pattern]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, all their new words coded together."""
        cut = [self.split(t) for t in texts]
        count = np.fromiter(map(len, cut), np.int64, len(cut))
        word = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(cut)), np.int64, int(count.sum()))
        if self.numbers.fresh:
            coded = self.coder.encode_words([w.encode("utf-8", "surrogatepass") for w in self.numbers.fresh])
            self.pool = np.concatenate([self.pool, *coded])
            self.size = np.concatenate([self.size, np.fromiter(map(len, coded), np.int64, len(coded))])
            self.numbers.fresh = []
        begin, size = np.cumsum(self.size) - self.size, self.size[word]
        end = np.cumsum(size)
        ids = self.pool[np.repeat(begin[word] - (end - size), size) + np.arange(int(size.sum()))]
        ends = np.r_[0, end][np.cumsum(count)]
        if len(self.numbers) > MEMORY_WORDS:
            self._keep(np.unique(word), begin)
        return np.split(ids, ends[:-1]) if len(texts) else []

    def _keep(self, used: np.ndarray, begin: np.ndarray) -> None:
        """Forget all words but those of the last texts, which are the frequent ones; with too many of them, all."""
        used = used if len(used) < MEMORY_WORDS // 2 else used[:0]
        size = self.size[used]
        at = np.repeat(begin[used] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        words = np.array(list(self.numbers), object)[used]
        self.numbers, self.pool, self.size = _Numbers(words), self.pool[at], size

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        return self.coder.decode(ids)


#: Characters that are cut and coded together.
CHARS_AT_ONCE = 8_000_000


def groups(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of about CHARS_AT_ONCE characters; a longer text is alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHARS_AT_ONCE:
            yield slice(first, i)
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield slice(first, len(texts))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches of (doc_id, text) put together to about CHARS_AT_ONCE bytes: a query costs the same for few words as for many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= CHARS_AT_ONCE:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts have no ids, a null doc_id stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(ranks_path, pattern)
        for batch in gathered(batches):
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for part in groups(texts):
                ids = vocabulary.encode(texts[part])
                yield pa.RecordBatch.from_arrays([doc_ids[part], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _slim(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) of every row of (doc_id, ids); null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(ranks_path, pattern)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            whole = vocabulary.decode([np.array(x or (), np.int32) for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else w for x, w in zip(ids, whole, strict=True)], pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encode, then decode the ids, in one pass: counts and digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(ranks_path, pattern)
        name = np.array([str(i) for i in range(len(vocabulary.coder.bytes_of))], object)
        for batch in gathered(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for part in groups(texts):
                ids = vocabulary.encode(texts[part])
                for one, whole in zip(ids, vocabulary.decode(ids), strict=True):
                    out["n_tokens"].append(len(one))
                    out["ids_sha256"].append(hashlib.sha256(",".join(name[one]).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out.values())], names=["doc_id", *out])

    return _slim(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
