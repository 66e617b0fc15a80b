"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary.

Distinct words are encoded by Spark higher-order functions: ``aggregate`` folds the ranked merges over the word's array of bytes,
looking ranks up in a literal map. A document is then the concatenation of its words' ids, so nothing is shuffled but the
counts that choose the frequent words, and texts of any size stay in the task that read them:

1. words are counted; the ``frequent`` ones most often repeated are encoded once and sent to all tasks (a bounded cache that
   has no effect on results);
2. a task splits each document and hands on, per document, word numbers and the bytes of words that it hasn't met before;
3. these are encoded by the same fold;
4. the task, which still has the ids of the words it met before, joins ids.

Words of more than 1,024 bytes are the exception: a fold's time grows with the square of a word's length, so these are merged
by a heap. Decoding concatenates the binary pieces of a document's ids in one Spark expression.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections import Counter
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shinglemill.llm.memory import collect_garbage, small_batches, trim, trim_driver, trimmed
from shinglemill.scratch import Scratch

#: Bits of a token id in a packed entry; an id that stands for "no merge".
_ID, _NONE = 17, (1 << 17) - 1
#: Words whose numbers, or counts, a task holds at once.
_WORDS = 50_000
#: Characters from which a text's words aren't held all at once.
_LONG = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class RankMap:
    """Pairs of ids and the id they merge into, as a perfect hash in two arrays that fit a literal.

    A pair (a, b) has the key ``a << 17 | b``. ``slots[(key % q + shift[key % m] * (key % r)) % n]`` is ``key << 17 | merged`` where
    the vocabulary has the bytes of a and b joined, and something else otherwise.
    """

    q, r = 2_147_483_629, 1_000_000_007

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values()) >= _NONE:
            raise ValueError("ids must stay below 2 ** 17 - 1")
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        self.ranks = ranks
        pairs = {}
        for piece, merged in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << _ID | b] = merged
        self.m, n = len(pairs) // 3 * 2 + 1, int(len(pairs) * 1.3)
        groups: dict[int, list[int]] = {}
        for key in pairs:
            groups.setdefault(key % self.m, []).append(key)
        order = sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))
        while True:
            n = next(i for i in range(n + 1, 2 * n + 9) if all(i % f for f in range(2, int(i**0.5) + 1)))
            if self._place(pairs, order, n):
                return

    def _place(self, pairs: dict, order: list, n: int) -> bool:
        """Finds a shift for every group, the largest first; n is a prime."""
        shift, slots = [0] * self.m, [-1] * n
        for group, members in order:
            parts = [(k % self.q % n, k % self.r % n) for k in members]
            for d in range(1 << 16):
                at = [(x + d * y) % n for x, y in parts]
                if all(slots[i] < 0 for i in at) and len(set(at)) == len(at):
                    break
            else:
                return False
            shift[group] = d
            for i, k in zip(at, members):
                slots[i] = k << _ID | pairs[k]
        self.shift, self.slots, self.n = shift, slots, n
        return True

    def merged(self):
        """A function of a column of keys: the id of the pair's merge, or ``_NONE``; a negative key stands for no pair."""
        slots = F.from_json(F.lit(str(self.slots)), "array<bigint>")
        shift = F.from_json(F.lit(str(self.shift)), "array<bigint>")

        def look(key):
            at = (key % self.q + F.get(shift, (key % self.m).cast("int")) * (key % self.r)) % self.n
            hit = _let(F.get(slots, at.cast("int")), lambda found: F.when(F.shiftright(found, _ID) == key, found.bitwiseAND(_NONE)).otherwise(F.lit(_NONE).cast("bigint")))
            return F.when(key < 0, F.lit(_NONE).cast("bigint")).otherwise(hit)

        return look

    def first_merges(self):
        """A function of two byte columns: the id of the merge of their ids, or ``_NONE``, from a table of all pairs of bytes."""
        table = [self.ranks.get(bytes([a, b]), _NONE) for a in range(256) for b in range(256)]
        literal = F.from_json(F.lit(str(table)), "array<bigint>")
        return lambda a, b: F.get(literal, (a * 256 + b).cast("int"))


def _let(value, body):
    """Evaluates ``value`` once for ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_word(word, ranks: RankMap):
    """A column ARRAY<INT> of ids from a column ARRAY<BIGINT> of the word's bytes.

    An entry of the fold's state is ``rank of the pair it starts << 46 | offset << 17 | id``, so that the smallest entry is the
    leftmost pair of the lowest rank. Each step merges that pair and renews the ranks on its two sides.
    """
    merged, first = ranks.merged(), ranks.first_merges()
    alphabet = F.from_json(F.lit(str(ranks.bytes)), "array<bigint>")
    none, gone, place = F.lit(_NONE).cast("bigint"), F.lit(-1).cast("bigint"), F.lit(((1 << 29) - 1) << _ID)

    def id_of(entry):
        return entry.bitwiseAND(_NONE)

    def entry(rank, offset, ident):
        return F.shiftleft(rank, 46).bitwiseOR(offset).bitwiseOR(ident)

    def start(raw):
        offsets = F.sequence(F.lit(0), F.size(raw) - 1)

        def at(i):
            after = F.get(raw, i + 1)
            rank = F.when(after.isNull(), none).otherwise(first(F.get(raw, i), after))
            return entry(rank, F.shiftleft(i.cast("bigint"), _ID), F.get(alphabet, F.get(raw, i).cast("int")))

        return F.transform(offsets, at)

    def step(state, _):
        def merge(low, at):
            new, before, after = F.shiftright(low, 46), F.get(state, at - 2), F.get(state, at + 1)
            left = F.when(before.isNull(), gone).otherwise(F.shiftleft(id_of(before), _ID).bitwiseOR(new))
            right = F.when(after.isNull(), gone).otherwise(F.shiftleft(new, _ID).bitwiseOR(id_of(after)))

            def renew(ranks_):
                own = entry(F.get(ranks_, F.lit(1)), low.bitwiseAND(place), new)
                previous = entry(F.get(ranks_, F.lit(0)), before.bitwiseAND(place), id_of(before))
                put = lambda x, i: F.when(i < at - 2, x).when(i > at, x).when(i == at - 1, own).when(i == at, gone).otherwise(previous)
                return F.array_remove(F.transform(state, put), gone)

            return _let(F.transform(F.array(left, right), merged), renew)

        return _let(F.array_min(state), lambda low: F.when(F.shiftright(low, 46) == _NONE, state).otherwise(_let(F.array_position(state, low).cast("int"), lambda at: merge(low, at))))

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1))), start(word), step)
    return F.transform(folded, id_of).cast("array<int>")


def _bytes_of(word):
    """The bytes of a binary column as ARRAY<BIGINT>."""
    return F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda c: F.ascii(c).cast("bigint"))


# Splitting -----------------------------------------------------------------------------------------------------------

#: The white space of the tokenizers' pattern: Unicode White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _class(name: str, upto: int = 0x250) -> str:
    return "".join(re.escape(chr(i)) for i in range(upto) if regex.match(name, chr(i)))


class Splitter:
    """Words of a text by the tokenizer's pattern. Texts of Latin letters go through the standard library's faster matcher,
    where the classes of letters and numbers are written out and white space means the same."""

    def __init__(self, pattern: str):
        full = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]")
        self.full, self.every = (lambda r: (r.findall, r.finditer))(regex.compile(full))
        latin = re.compile(full.replace(r"\p{L}+", f"[{_class(r'\p{L}')}]+").replace(r"\p{N}+", f"[{_class(r'\p{N}')}]+").replace(r"\p{L}", _class(r"\p{L}")).replace(r"\p{N}", _class(r"\p{N}")))
        self.latin, self.every_latin = latin.findall, latin.finditer
        self.other = re.compile("[\u0250-\U0010ffff]").search

    def __call__(self, text: str):
        """All words; of a long text one after the other, so that they needn't be held at once."""
        if len(text) > _LONG:
            return (m.group() for m in (self.every if self.other(text) else self.every_latin)(text))
        return self.full(text) if self.other(text) else self.latin(text)


def _slices(column, size: int = 1 << 20):
    """Runs of an Arrow column of texts of about ``size`` bytes, as start and list, so that memory doesn't follow the batch."""
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, column.slice(at, upto - at).to_pylist()
        at = upto


class _Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def word_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """``(word BINARY, n)`` of the first column of ``texts`` over all rows."""

    def run(batches):
        split = Splitter(pattern)
        seen: Counter = Counter()

        def flush():
            keys = list(seen)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w.encode() for w in part], pa.binary()), pa.array([seen[w] for w in part], pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for _, part in _slices(batch.column(0)):
                seen.update(chain.from_iterable(map(split, part)))
                if len(seen) > 2 * _WORDS:
                    yield from flush()
        yield from flush()

    return texts.mapInArrow(trimmed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


# Encoding ------------------------------------------------------------------------------------------------------------


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` words of at most 256 bytes, those counted most often, cut between two counts."""
    counts = counts.filter(F.octet_length("word") <= 256)
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["s"], r["c"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("c")).collect()), reverse=True)
    least, total = None, 0
    for s, c in sizes:
        if total + c > most:
            break
        least, total = s, total + c
    return counts.filter(step >= least) if least is not None else counts.filter("false")


class _Lists:
    """Runs of numbers, one after the other in ``flat``."""

    def __init__(self, flat, sizes, starts=None):
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes) - sizes if starts is None else starts

    def __len__(self):
        return len(self.sizes)

    @staticmethod
    def none() -> _Lists:
        return _Lists(np.empty(0, np.int32), np.empty(0, np.int64))

    @staticmethod
    def of(column) -> _Lists:
        """The runs of an Arrow column of lists."""
        return _Lists(np.asarray(column.flatten()), pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64))

    def __add__(self, more: _Lists) -> _Lists:
        return _Lists(np.concatenate([self.flat, more.flat]), np.concatenate([self.sizes, more.sizes]))


def _gather(known: _Lists, fresh: _Lists, codes):
    """The runs of ``codes``, joined, and the end of each; codes from ``len(known)`` on are those of ``fresh``."""
    new = codes >= len(known)
    if not new.any():
        n, start = known.sizes[codes].astype(np.int64), known.starts[codes].astype(np.int64)
    else:
        n, start = np.empty(len(codes), np.int64), np.empty(len(codes), np.int64)
        old, late = codes[~new], codes[new] - len(known)
        n[~new], start[~new] = known.sizes[old], known.starts[old]
        n[new], start[new] = fresh.sizes[late], len(known.flat) + fresh.starts[late]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n - start, n)
    if not new.any():
        return known.flat[at], ends
    out, low = np.empty(len(at), np.int32), at < len(known.flat)
    out[low], out[~low] = known.flat[at[low]], fresh.flat[at[~low] - len(known.flat)]
    return out, ends


def merge_long(raw: bytes, ranks: dict[bytes, int], longest: int) -> list[int]:
    """The ids of a very long word: the same merges in the same order by a heap, in about n log n steps, where a fold takes n * n."""
    n = len(raw)
    stop, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a byte; a stop of 0: merged away

    def pair(i):
        mid = stop[i]
        if mid < n and stop[mid] - i <= longest:
            rank = ranks.get(raw[i : stop[mid]])
            if rank is not None:
                return rank, i, mid, stop[mid]

    heap = [p for p in map(pair, range(n)) if p]
    heapq.heapify(heap)
    while heap:
        _, i, mid, end = heapq.heappop(heap)
        if stop[i] != mid or stop[mid] != end:
            continue
        stop[i], stop[mid] = end, 0
        if end < n:
            before[end] = i
        for j in (before[i], i):
            if j >= 0 and (p := pair(j)):
                heapq.heappush(heap, p)
    ids, at = [], 0
    while at < n:
        ids.append(ranks[raw[at : stop[at]]])
        at = stop[at]
    return ids


def encode(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text: str = "text", frequent: int = 700_000, most_fresh: int = 100_000, long_word: int = 1_024) -> DataFrame:
    """``(id, ids)`` for every row of ``docs``: the ids of its whole text by the rank file ``tokenizer``, every match of ``pattern``
    encoded separately, without special tokens.

    A null or empty text has no ids. Repeated rows, and rows with a null id, are encoded each; very long texts are split as
    they are read; other columns are ignored; an empty table gives no rows. ``frequent`` bounds the words that tasks get
    beforehand (about 30 bytes each); other words are encoded once where they occur, at most about ``most_fresh`` being
    remembered. Words above ``long_word`` bytes are merged by a heap, as a fold's time grows with the square of a word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    collect_garbage(spark)
    ranks = read_ranks(tokenizer)
    table = RankMap(ranks)
    # The rank map is a literal of some MB; without a bound every description of a plan would spell it out.
    if int(spark.conf.get("spark.sql.maxPlanStringLength").rstrip("b")) > 1 << 24:
        spark.conf.set("spark.sql.maxPlanStringLength", str(1 << 20))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text), F.lit("")).alias("text"))
    scratch = Scratch(spark, "bpe")
    counts = scratch.keep(word_counts(rows.select("text"), pattern), "counts")
    words = _frequent(counts, frequent).select("word", _bytes_of(F.col("word")).alias("bytes"))
    known = scratch.keep(words.select(F.xxhash64("word").alias("hash"), F.crc32("word").alias("check"), encode_word(F.col("bytes"), table).alias("ids")), "known").toArrow()
    scratch.drop("counts", "known")
    hashed, checks = known["hash"].to_numpy(), known["check"].to_numpy().astype(np.uint32)
    sizes = pc.list_value_length(known["ids"]).to_numpy().astype(np.int64)
    flat = np.concatenate([np.asarray(c.flatten()) for c in known["ids"].chunks] or [np.empty(0, np.int32)])
    del known
    order = np.argsort(hashed)
    n_known = len(order)
    starts = np.cumsum(sizes) - sizes
    index = spark.sparkContext.broadcast((hashed[order], checks[order]))
    lists = spark.sparkContext.broadcast((flat, sizes[order].astype(np.int32), starts[order].astype(np.int32)))
    long_ranks = spark.sparkContext.broadcast((ranks, max(map(len, ranks))))
    del hashed, checks, sizes, flat, order, starts, ranks
    trim()
    trim_driver(spark)

    def number(batches):
        hashes, checks = index.value
        split = Splitter(pattern)
        local, codes_of, fresh, generation = _Numbers(), np.empty(0, np.int32), {}, 0

        def learn(words: list) -> tuple[np.ndarray, list]:
            """Codes of words, and the bytes of those that this task doesn't know; long ones as ids already, below zero."""
            raw = [w.encode() for w in words]
            hashed = np.fromiter(map(xxhash.xxh64_intdigest, raw, repeat(42)), np.uint64, len(raw)).view(np.int64)
            crc = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
            at = np.minimum(np.searchsorted(hashes, hashed), max(len(hashes) - 1, 0)).astype(np.int32)
            hit = (hashes[at] == hashed) & (checks[at] == crc) if len(hashes) else np.zeros(len(words), bool)
            new = []
            for i in np.flatnonzero(~hit).tolist():
                if words[i] not in fresh:
                    fresh[words[i]] = n_known + len(fresh)
                    new.append(list(raw[i]) if len(raw[i]) <= long_word else [-1 - t for t in merge_long(raw[i], *long_ranks.value)])
                at[i] = fresh[words[i]]
            return at, new

        for batch in batches:
            for at, part in _slices(batch.column(1)):
                if len(local) > _WORDS or len(fresh) > most_fresh:
                    local, codes_of = _Numbers(), codes_of[:0]
                if len(fresh) > most_fresh:
                    fresh.clear()
                    generation += 1
                numbers = [np.fromiter(map(local.__getitem__, split(t)), np.int32) for t in part]
                sizes = np.fromiter(map(len, numbers), np.int64, len(part))
                met, new = learn(list(islice(local, len(codes_of), None)))
                codes_of = np.concatenate([codes_of, met])
                codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(codes_of[np.concatenate(numbers)]))
                first = [new] + [[]] * (len(part) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), codes, pa.array(first, pa.list_(pa.list_(pa.int64()))), pa.array(np.full(len(part), generation, np.int32))], ["id", "codes", "fresh", "generation"])

    def join(batches):
        known = _Lists(*lists.value)
        fresh, generation = _Lists.none(), -1
        for batch in batches:
            born = batch.column("generation").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(born)) + 1).tolist(), len(born)] if len(born) else [0]
            for low, high in zip(bounds, bounds[1:]):
                part = batch.slice(low, high - low)
                if born[low] != generation:
                    fresh, generation = _Lists.none(), born[low]
                words = part.column("encoded").flatten()
                if len(words):
                    fresh = fresh + _Lists.of(words)
                column = part.column("codes")
                offsets, codes = np.asarray(column.offsets), np.asarray(column.values)
                at = 0
                while at < len(column):
                    upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 50_000, "right")) - 1)
                    runs, ends = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
                    for first in range(offsets[at], offsets[upto], 50_000):  # more than one step for a very long text only
                        ids, stops = _gather(known, fresh, codes[first : min(first + 50_000, offsets[upto])])
                        runs.append(ids)
                        ends.append(stops + ends[-1][-1])
                    ends = np.concatenate(ends)[offsets[at : upto + 1] - offsets[at]]
                    yield pa.RecordBatch.from_arrays([part.column("id").slice(at, upto - at), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(runs)))], [id_col, "ids"])
                    at = upto

    kind = dict(docs.dtypes)[id_col]
    numbered = rows.mapInArrow(trimmed(number), f"id {kind}, codes array<int>, fresh array<array<bigint>>, generation int")
    given = lambda w: F.transform(w, lambda x: (-1 - x).cast("int"))
    encoded = numbered.select("id", "codes", F.transform("fresh", lambda w: F.when(F.get(w, F.lit(0)) < 0, given(w)).otherwise(encode_word(w, table))).alias("encoded"), "generation")
    return encoded.mapInArrow(trimmed(join), f"`{id_col}` {kind}, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", out: str = "content") -> DataFrame:
    """``encoded`` with the column ``out BINARY``: the binary pieces of every row's ids, concatenated. Null ids and ids that the
    vocabulary doesn't have give nothing. Bytes go through string columns as they are, since strings can be joined in one step."""
    pieces = F.from_json(F.lit(_pieces_json(read_ranks(tokenizer))), "array<binary>").cast("array<string>")
    parts = F.transform(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda i: F.get(pieces, i))
    return encoded.withColumn(out, F.array_join(parts, "").cast("binary"))


def _pieces_json(ranks: dict[bytes, int]) -> str:
    by_id = {i: base64.b64encode(p).decode() for p, i in ranks.items()}
    return "[" + ",".join(f'"{by_id[i]}"' if i in by_id else "null" for i in range(max(by_id) + 1)) + "]"


def digests(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the encoded and decoded text of every document."""
    decoded = decode(encode(docs, tokenizer, pattern), tokenizer)
    decimal = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal.cast("binary"), 256).alias("ids_sha256"), F.sha2("content", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op10_byte_bpe": op10_byte_bpe}
