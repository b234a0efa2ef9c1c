"""Best-two-fit packing of token pieces into sequences of bounded length.

Best-two-fit fills a bin greedily with the longest document that still fits, then takes the
bin's smallest document out again if two unpacked documents fill the widened gap more tightly.
Which bins come out depends on the lengths alone, and a length is a whole number up to the
capacity. So the method runs on the histogram of lengths (``capacity`` counts at most, however
many documents there are): it finds the next bin's pattern and repeats it for as long as every
choice would be made again. The pieces then take their places in parallel: pieces of one
length are numbered (in salted groups, since one length may hold a third of all rows), and a
number falls into a pattern's range. No list of bins is ever walked.

Defined results: a null text is an empty document, one end token long; repeated rows and ids
are packed each on its own; documents over the capacity are cut into full pieces and a rest;
an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from linkloom.llm.common import lean, local_table, partitions, salts, small_batches, stored

CAPACITY = 4096
END_ID = 1
#: Characters of text that are cut into parts at once.
SLICE = 262_144


# ---------------------------------------------------------------- tokens

def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the others follow from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [x for x in range(256) if x not in shown]
    return {x: 256 + i for i, x in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    """The one tokenizer of a Python process, without threads of its own (tasks run side by side).

    Each further tokenizer leaves some 20 MB behind for good, most of it in its threads, and a
    Python worker runs many tasks.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


class WordIds:
    """Little-endian token ids of texts, by parts that the tokenizer treats alone.

    The vocabulary drops white space, folds case, and splits letters and digits from other
    characters; no merge crosses such a border. So a text is cut at blanks, and before a full
    stop or comma that ends a stretch and follows a letter or digit. (A stop behind other
    characters would belong to them. A capital dotted I gains a combining mark by folding.) Texts
    that do not allow this throughout are cut finer, by ``PARTS``. Parts recur far more often
    than words with their punctuation do; each is encoded once.

    The memory is bounded: ``most`` parts are kept, none longer than ``longest``; when the store
    is full, parts not met since it was last full go. Long texts are cut at blanks.
    """

    # Letters before ASCII or the end; a digit before ASCII; punctuation without apostrophes
    # before a letter, a digit or a blank; the rest of a stretch.
    PARTS = re.compile(r"[^\W\d_\u0130]++(?=[\x00-\x7f]|\Z)|[0-9](?![^\x00-\x7f])"
                       r"|[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9 \n]|\Z)|[^ \n]+")

    def __init__(self, path: str, most: int = 600_000, longest: int = 64):
        self.tokenizer, self.most, self.longest = _tokenizer(path), most, longest
        self.model = self.tokenizer.model
        self.known: dict[bytes, bytes] = {}
        self.met: set[bytes] = set()

    def _each(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, new: list[bytes]) -> None:
        """Ids of new parts. Latin letters alone are one word: folded, it is written in the
        vocabulary's letters for bytes and cut by its model at once."""
        rest, texts, cut = [], [], self.model.tokenize
        for x in new:
            if x.isalpha() and len(x) <= self.longest:  # ASCII, in small letters already
                self.known[x] = array("I", [t.id for t in cut(x.decode())]).tobytes()
                continue
            text = x.decode("utf-8", "surrogatepass")
            if text.isalpha() and len(text) <= self.longest and max(text) < "\u0250" and "\u0130" not in text:
                folded = unicodedata.normalize("NFC", text).lower().encode().decode("latin-1").translate(BYTE_LETTERS)
                self.known[x] = array("I", [t.id for t in cut(folded)]).tobytes()
            else:
                rest.append(x)
                texts.append(text)
        self.known.update(zip(rest, self._each(texts)))

    def _parts(self, text: str) -> list[bytes]:
        plain = text.replace("\n", " ") + " "
        for stop in (". ", ", "):
            pieces = plain.split(stop)
            ends = "".join([x[-1:] for x in pieces[:-1] if x[-1:] != " "])
            if ends and (not ends.isalnum() or "\u0130" in ends):
                return [x.encode("utf-8", "surrogatepass").lower() for x in self.PARTS.findall(text)]
            plain = f" {stop}".join(pieces)
        return plain.encode("utf-8", "surrogatepass").lower().split(b" ")

    def _slices(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > SLICE:
            upto = max(text.rfind(" ", at, at + SLICE), text.rfind("\n", at, at + SLICE))
            if upto <= at:  # one stretch; it ends at the next blank
                found = [x for x in (text.find(" ", at + SLICE), text.find("\n", at + SLICE)) if x > 0]
                upto = min(found, default=len(text))
            out.append(text[at:upto])
            at = upto
        out.append(text[at:])
        return out

    def _of_slices(self, slices: list[str]) -> list[bytes]:
        cut = [self._parts(x) for x in slices]
        distinct = set().union(*cut)
        new = [x for x in distinct if x not in self.known]
        if len(self.known) + len(new) > self.most:
            kept = self.met | distinct
            self.known = {x: i for x, i in self.known.items() if x in kept} if len(kept) <= self.most // 2 else {}
            self.met = set()
            new = [x for x in distinct if x not in self.known]
        self.met |= distinct
        self._encode(new)
        out = [b"".join(map(self.known.__getitem__, parts)) for parts in cut]
        for x in new:
            if len(x) > self.longest:
                del self.known[x]
                self.met.discard(x)
        return out

    def of(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; texts are taken together while they are short."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            if "<|" in text:  # maybe a special token, which is taken as it stands
                yield from self._flush(held)
                held, size = [], 0
                yield self._each([text])[0]
                continue
            held.append(self._slices(text))
            size += len(text)
            if size > SLICE:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[str]]) -> Iterator[bytes]:
        if len(held) == 1 and len(held[0]) > 1:
            yield b"".join(self._of_slices([x])[0] for x in held[0])
            return
        flat = self._of_slices([x for slices in held for x in slices]) if held else []
        at = 0
        for slices in held:
            yield b"".join(flat[at:at + len(slices)])
            at += len(slices)


PIECE = StructType([StructField("piece", IntegerType()), StructField("start", LongType()),
                    StructField("length", LongType()), StructField("ids", BinaryType())])


def tokenize(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
             capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian 32-bit numbers, the text's
    tokens and then ``end_id``, cut into pieces of ``capacity``."""
    small_batches(docs.sparkSession, 500)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(tokenizer)  # one store per task: a kept one would hold its memory for good
        for batch in batches:
            rows = []
            for key, ids in zip(batch["doc_id"], words.of(batch["text"])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(part) // 4, part))
                if len(rows) >= 500:
                    yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInPandas(lean(run), StructType([rows.schema["doc_id"], *PIECE.fields]))


# ---------------------------------------------------------------- bins

def patterns(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins by best-two-fit from ``counts[length]``: (how many such bins, [(length, how many of it)]).

    Each step uses up at least one length or leaves fewer of it than the bin needs, so there are
    few more patterns than lengths.
    """
    counts = counts.astype(np.int64).copy()
    capacity = len(counts) - 1
    index = np.arange(capacity + 1)

    def upto(have: np.ndarray) -> np.ndarray:
        """For every x the longest available length of at most x, or 0."""
        return np.maximum.accumulate(np.where(have > 0, index, 0))

    out = []
    longest = upto(counts)
    while longest[capacity]:
        have, gap = counts.copy(), capacity
        used: dict[int, int] = {}
        x = int(longest[gap])
        while x:
            k = min(int(have[x]), gap // x)
            used[x] = used.get(x, 0) + k
            have[x] -= k
            gap -= k * x
            x = int(longest[min(gap, x - 1)])
        peak = dict(used)
        if gap and sum(used.values()) > 1:
            small = min(used)
            room = gap + small
            rest = upto(have)
            a = np.flatnonzero(have[:room] > 0)
            if len(a):
                b = rest[np.minimum(room - a, a)]
                b = np.where((b == a) & (have[a] < 2), rest[a - 1], b)
                fill = np.where(b > 0, a + b, 0)
                best = len(fill) - 1 - int(fill[::-1].argmax())  # of equal fills the one with the longest
                if fill[best] > small:
                    used[small] -= 1
                    if not used[small]:
                        del used[small]
                    for y in (int(a[best]), int(b[best])):
                        used[y] = used.get(y, 0) + 1
                        peak[y] = max(peak.get(y, 0), used[y])
        times = min(int(counts[x]) // n for x, n in peak.items())
        # The swapped-out document goes back, so ``peak`` may exceed what is left in a last round.
        times = max(times, 1)
        for x, n in used.items():
            counts[x] -= n * times
        out.append((times, sorted(used.items(), reverse=True)))
        longest = upto(counts)
    return out


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Where the k-th piece of a length goes: sorted ranges of (length, k)."""
    taken: dict[int, int] = {}
    rows, bin_ = [], 0
    for times, content in found:
        offset = 0
        for length, n in content:
            k = taken.get(length, 0)
            rows.append((length, k, bin_, n, offset))
            taken[length] = k + n * times
            offset += n * length
        bin_ += times
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "bin", "n", "offset"), cols)) | {"key": (cols[0] << 44) + cols[1]}


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (any columns, with a whole ``length`` from 1 to ``capacity``) with the
    sequence each one is in and its offset there; these two replace columns of their names.
    The numbering of equal lengths follows ``order``, then the place in the written table."""
    spark, c = pieces.sparkSession, F.col
    fields = [f for f in pieces.schema.fields if f.name.lower() not in ("sequence_id", "offset")]
    # Own names while we work, so that none of the input's clashes with ours.
    names = {f.name: f"in{i}" for i, f in enumerate(fields)}
    length, keys = names["length"], [names[x] for x in order]
    plain = pieces.select(*[c(f"`{f.name}`").alias(names[f.name]) for f in fields])
    plain = stored(plain.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in plain.groupBy(length).count().collect():  # one row per length, ``capacity`` at most
        counts[size] = n
    plan = spark.sparkContext.broadcast(places(patterns(counts)))  # bounded by ``capacity`` too

    total = int(counts.sum())
    cut = (local_table(spark, [(i, int(n)) for i, n in enumerate(counts) if n], {"size": pa.int64(), "n": pa.int64()})
           .select("size", salts(c("n"), F.lit(total), partitions(spark)).alias("cut")))
    # Both tables that are broadcast here are bounded: ``capacity`` rows, and four more per partition.
    salted = (plain.join(F.broadcast(cut), c(length) == c("size"))
              .withColumn("salt", F.pmod(F.xxhash64("uid"), c("cut"))).drop("cut"))
    by_size = Window.partitionBy("size").orderBy("salt")
    before = (salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
              .select(c("size").alias("_size"), c("salt").alias("_salt"), (F.sum("n").over(by_size) - c("n")).alias("before")))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("size", "salt").orderBy(*keys, "uid")))
    ranked = (ranked.join(F.broadcast(before), (c("size") == c("_size")) & (c("salt") == c("_salt")))
              .select(*names.values(), (c("before") + c("rank") - 1).alias("k")))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        for batch in batches:
            size, k = batch[length].to_numpy(), batch.pop("k").to_numpy()
            at = np.searchsorted(p["key"], (size << 44) + k, side="right") - 1
            turn = k - p["first"][at]
            batch["sequence_id"] = p["bin"][at] + turn // p["n"][at]
            batch["offset"] = p["offset"][at] + turn % p["n"][at] * size
            yield batch

    out = [StructField(names[f.name], f.dataType) for f in fields]
    placed = ranked.mapInPandas(lean(place), StructType([*out, StructField("sequence_id", LongType()), StructField("offset", LongType())]))
    return placed.toDF(*[f.name for f in fields], "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences themselves, from pieces with ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # bounded by the capacity
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
            .select("sequence_id", "length",
                    F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids")))
