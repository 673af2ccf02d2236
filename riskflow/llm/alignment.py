"""Alignment of two tokenizers over a corpus: groups of tokens that share byte bounds, linked ids, and in how many documents each linked pair occurs.

Spark gathers the distinct linked pairs and builds a minimal perfect hash of them, in shards by hash. Each task counts its
documents in a dense vector indexed by that hash; the vectors are summed in a tree. A second pass aligns the documents
again and looks the counts up, each key verified.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm.common import column, mix64, rows_out, slices, table, written
from riskflow.llm.tokens import PLAIN, byte_alphabet, fast_tokenizer
from riskflow.session import freeze

#: Documents that are aligned at once.
ROWS = 128
#: Bytes that one worker remembers of pieces of text already aligned; beyond them it starts anew.
REMEMBERED_BYTES = 160 << 20
#: Pairs that a task gathers before it passes them on.
HELD_PAIRS = 1 << 20
#: Keys of a shard of the hash, on average; slots a key on a level; keys whose hash, keys and counts are sent to every worker at once
#: (about 17 bytes each). More keys are counted and looked up in several such rounds.
SHARD_KEYS = 1 << 15
SLOTS = 2
ROUND_KEYS = 1 << 22
#: Numbers of a dense vector that travel together, and vectors that one step of the tree adds.
CHUNK = 1 << 16
FAN = 32

#: Ids of both tokenizers fit so many bits; a document's number in its batch stands above a pair.
A_BITS = 24
#: Plain words are encoded so many at a time, joined by line feeds.
JOINED = 256
#: Marks pieces that show that their text must be cut with more care.
UNCUT = -2
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)")


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places (in a, in b) of all pairs of tokens whose byte ranges overlap; both cover the same bytes without a gap."""
    first = np.searchsorted(b_ends, np.concatenate([[0], a_ends[:-1]]), side="right")
    times = np.searchsorted(b_ends, a_ends, side="left") + 1 - first
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    return np.repeat(np.arange(len(a_ends)), times), np.repeat(first, times) + nth


class Pieces(dict):
    """Numbers for pieces of text in the order in which they are first met; new ones wait in ``new``."""

    def __init__(self, owner: Aligner):
        self.owner, self.new = owner, []

    def __missing__(self, piece: str) -> int:
        slot = self[piece] = self.owner.slots
        self.owner.slots += 1
        self.new.append((slot, piece))
        return slot


class Aligner:
    """Alignment of whole texts, pieced together from alignments of their words.

    Both vocabularies are looked through for tokens that could join text across a space, or a line feed, between two characters that are
    not white space. As there are none, texts are cut there, and each distinct piece is aligned once. Else texts are not cut.
    """

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        a_bytes = {i: bytes(alphabet[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=False).items() if all(c in alphabet for c in t)}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(self.a.get_vocab_size())]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lone = self.b.piece_to_id("▁")
        self.cuts = not any("\n" in x or re.search("[^▁]▁", x) for i, x in enumerate(names) if not self.b.is_byte(i))
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.a_bytes, self.b_bytes))
        self.a_says, self.b_says = list(map(str, range(len(self.a_bytes)))), list(map(str, range(len(self.b_bytes))))
        self.feed, self.b_feed = self.a.encode("\n", add_special_tokens=False).ids[0], self.b.encode("\n")[-1]
        self.fast = fast_tokenizer(path_a)
        self.say = False
        self._forget()

    def _forget(self) -> None:
        self.slots = self.held = self.used = 0
        self.words, self.others = Pieces(self), Pieces(self)  # words that follow a space, or a line feed that they hold; other pieces
        self.facts = np.zeros((1 << 10, 5), np.int64)  # tokens of a and b (-1: not the text's bytes), groups, pairs: number and place
        self.groups: list[str] = []
        self.pairs = np.zeros(1 << 14, np.int64)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids of a and how many each piece has, the same of b: many pieces at a time with a line feed, a token of its own, between them."""
        led = np.array([p[0] == "\n" for p in pieces])
        got = []
        for at in range(0, len(pieces), JOINED):
            text = "".join([p if p[0] == "\n" else f"\n{p}" for p in pieces[at : at + JOINED]])
            a = self.fast.encode_ordinary(text) if self.fast else self.a.encode(text, add_special_tokens=False).ids
            got.append((a, self.b.encode(text)[1:]))
        out = []
        for feed, parts in zip((self.feed, self.b_feed), zip(*got)):
            ids = np.fromiter(chain.from_iterable(parts), dtype=np.int64, count=sum(map(len, parts)))
            feeds = np.flatnonzero(ids == feed)
            if len(feeds) != len(pieces) or feeds[0]:
                return None
            n = np.diff(feeds, append=len(ids))
            # the line feeds between pieces are not theirs
            out += [np.delete(ids, feeds[~led]), n - ~led]
        return tuple(out)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for any pieces, each for itself."""
        own_a = [x.ids for x in self.a.encode_batch_fast(pieces, add_special_tokens=False)]
        own_b = self.b.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        own_b = [b if p[0] == " " else b[1:] if b[0] == self.lone else [] for p, b in zip(pieces, own_b)]
        return tuple(x for own in (own_a, own_b) for x in (np.fromiter(chain.from_iterable(own), dtype=np.int64), np.array(list(map(len, own)), dtype=np.int64)))

    def _learn(self) -> None:
        while self.slots > len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        self.groups += [""] * (self.slots - len(self.groups))
        plain, others = [], self.others.new
        for slot, piece in self.words.new:
            led = piece[:1] == "\n"
            bare = piece[1:] if led else piece
            full = piece if led else f" {piece}"
            if bare and bare.isprintable() and max(bare) < PLAIN:
                plain.append((slot, full))
            elif not bare or bare[0].isspace() or bare[-1].isspace():
                self.facts[slot, 0] = UNCUT  # white space beside the space: not a place to cut
            else:
                others.append((slot, full))
        self.words.new, self.others.new = [], []
        for new, joined in ((plain, True), (others, False)):
            for at in range(0, len(new), 4096):
                slots, pieces = map(list, zip(*new[at : at + 4096]))
                self._align(np.array(slots), pieces, joined and self._joined(pieces) or self._apart(pieces))

    def _align(self, slots: np.ndarray, pieces: list[str], ids: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> None:
        a_all, a_n, b_all, b_n = ids
        data = [p.encode() for p in pieces]
        sizes = np.array(list(map(len, data)), dtype=np.int64)
        if not self._spells(a_all, b_all, data):
            a_cut, b_cut = np.split(a_all, np.cumsum(a_n)[:-1]), np.split(b_all, np.cumsum(b_n)[:-1])
            good = np.array([self._spells(a, b, [d]) for a, b, d in zip(a_cut, b_cut, data)])
            self.facts[slots[~good], 0] = -1
            a_all, b_all, slots, sizes = a_all[np.repeat(good, a_n)], b_all[np.repeat(good, b_n)], slots[good], sizes[good]
            if not len(slots):
                return
        a_ends, b_ends, ends = np.cumsum(self.a_sizes[a_all]), np.cumsum(self.b_sizes[b_all]), np.cumsum(sizes)
        i, j = overlaps(a_ends, b_ends)
        a_bound = b_ends[np.searchsorted(b_ends, a_ends)] == a_ends
        per = lambda own: np.diff(np.searchsorted(own, ends, side="right"), prepend=0)
        n_pairs, n_groups = per(a_ends[i]), per(a_ends[a_bound])
        while self.used + len(i) > len(self.pairs):
            self.pairs = np.concatenate([self.pairs, np.zeros_like(self.pairs)])
        self.pairs[self.used : self.used + len(i)] = (a_all[i] << A_BITS) | b_all[j]
        self.facts[slots] = np.stack([per(a_ends), per(b_ends), n_groups, n_pairs, self.used + np.cumsum(n_pairs) - n_pairs], axis=1)
        self.used += len(i)
        self.held += 250 * len(slots) + int(sizes.sum()) + 16 * len(i)
        if self.say:
            a_text, b_text = list(map(self.a_says.__getitem__, a_all.tolist())), list(map(self.b_says.__getitem__, b_all.tolist()))
            a_at, b_at = (np.flatnonzero(x) + 1 for x in (a_bound, a_ends[np.searchsorted(a_ends, b_ends)] == b_ends))
            said, x, y = [], 0, 0
            for u, v in zip(a_at.tolist(), b_at.tolist()):
                said.append(f"{a_text[x] if u == x + 1 else ','.join(a_text[x:u])}|{b_text[y] if v == y + 1 else ','.join(b_text[y:v])}")
                x, y = u, v
            x = 0
            for slot, n in zip(slots.tolist(), n_groups.tolist()):
                self.groups[slot] = ";".join(said[x : x + n])
                x += n
            self.held += 12 * (len(a_all) + len(b_all))

    def _spells(self, a: np.ndarray, b: np.ndarray, data: list[bytes]) -> bool:
        whole = b"".join(data)
        return all(b"".join(map(own.__getitem__, ids.tolist())) == whole for own, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        """The slots of each text's pieces; none where the text has no tokens."""
        if self.held > REMEMBERED_BYTES:
            self._forget()
        none, out = np.zeros(0, np.int64), []
        for text in texts:
            parts = text.replace("\n", " \n").split(" ") if text and self.cuts else []
            out.append(np.fromiter(map(self.words.__getitem__, parts), dtype=np.int64, count=len(parts)))
        self._learn()
        for i, text in enumerate(texts):
            if text and (not self.cuts or self.facts[out[i], 0].min() == UNCUT):
                out[i] = np.array([self.others[p] for p in (CUT.split(f" {text}") if self.cuts else [f" {text}"])], dtype=np.int64)
        self._learn()
        return [s if len(s) and self.facts[s, 0].min() >= 0 else none for s in out]

    def pairs_of(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of all ``slots`` in their order, and how many each slot has."""
        n, at = self.facts[slots, 3], self.facts[slots, 4]
        return self.pairs[np.repeat(at - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str, say: bool = False) -> Aligner:
    """This worker's aligner; ``say``: with the groups' text."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    own = _aligners[path_a, path_b]
    if own.say != say:
        own._forget()
        own.say = say
    return own


class PerfectHash:
    """A minimal perfect hash of the keys of some shards: the rank of a key's bit among all bits that are set."""

    def __init__(self, shards: int, rows: list[tuple[int, list[int], bytes, bytes]]):
        """``rows``: shard, number of slots of each level, bits of all levels, and the keys in the order of their bits."""
        self.shards = shards
        levels = max((len(sizes) for _, sizes, _, _ in rows), default=0)
        self.sizes, self.starts = np.zeros((shards, levels), np.int64), np.zeros((shards, levels), np.int64)
        at = 0
        for shard, sizes, _, _ in rows:
            for level, size in enumerate(sizes):
                self.sizes[shard, level], self.starts[shard, level] = size, at
                at += size
        self.bits = np.frombuffer(b"".join(r[2] for r in rows), dtype="<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits).astype(np.int64))])
        self.keys = np.frombuffer(b"".join(r[3] for r in rows), dtype="<i8")

    @staticmethod
    def slot(keys: np.ndarray, level: int, sizes: np.ndarray | int) -> np.ndarray:
        return (mix64(keys.astype(np.uint64) + mix64(np.full(1, level + 1))) >> np.uint64(2)).astype(np.int64) % sizes

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[list[int], bytes, bytes]:
        """Slots of each level, bits and keys of one shard: on each level the keys alone in their slot are placed, the others go on."""
        sizes, bits, placed = [], [], []
        while len(keys):
            size = -(-SLOTS * len(keys) // 64) * 64
            at = cls.slot(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            own = alone[at]
            placed.append(keys[own][np.argsort(at[own])])
            bits.append(np.packbits(alone, bitorder="little").tobytes())
            sizes.append(size)
            keys = keys[~own]
        return sizes, b"".join(bits), np.concatenate([np.zeros(0, np.int64), *placed]).astype("<i8").tobytes()

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for those that are not among the hash's keys."""
        out, shard = np.full(len(keys), -1, np.int64), shard_of(keys, self.shards)
        live = np.arange(len(keys))
        for level in range(self.sizes.shape[1]):
            sizes = self.sizes[shard[live], level]
            live = live[sizes > 0]
            at = self.starts[shard[live], level] + self.slot(keys[live], level, sizes[sizes > 0])
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            set_ = ((word >> bit) & np.uint64(1)).astype(bool)
            rank = self.before[at >> 6] + np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[live[set_]] = rank[set_]
            live = live[~set_]
        out[out >= 0] = np.where(self.keys[out[out >= 0]] == keys[out >= 0], out[out >= 0], -1)
        return out


def spread(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys) >> np.uint64(1)).astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return spread(keys) % shards


def linked_pairs(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``pairs``: the different linked pairs of each document that has tokens; written to the shared folder."""
    schema = pa.schema([("pairs", pa.list_(pa.int64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in slices(batches, ROWS):
            found = [np.unique(s) for s in own(column(batch, "text"))]
            pairs, per_slot = own.pairs_of(np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            doc = np.repeat(np.repeat(np.arange(len(found)), [len(s) for s in found]), per_slot)
            once = np.unique((doc << 2 * A_BITS) | pairs)
            cuts = np.searchsorted(once >> 2 * A_BITS, np.unique(doc))
            arrays = pa.ListArray.from_arrays(pa.array([*cuts, len(once)], type=pa.int32()), pa.array(once & ((1 << 2 * A_BITS) - 1)))
            yield pa.RecordBatch.from_arrays([arrays], schema=schema)

    return written(docs.select("text").mapInArrow(work, "pairs array<long>"))


def distinct_pairs(linked: DataFrame) -> DataFrame:
    """``pair, place``: every linked pair of the corpus once, and its hash; written."""
    schema = pa.schema([("pair", pa.int64()), ("place", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in slices(batches):
            held = np.unique(np.concatenate([held, batch.column(0).flatten().to_numpy(zero_copy_only=False)]))
            if len(held) > HELD_PAIRS:
                yield rows_out(schema, [held, spread(held)])
                held = held[:0]
        yield rows_out(schema, [held, spread(held)])

    return freeze(linked.mapInArrow(work, "pair long, place long").distinct())


HASHED = pa.schema([("shard", pa.int32()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("keys", pa.binary())])


def perfect_hash(pairs: DataFrame, n: int) -> tuple[DataFrame, int]:
    """One row a shard of the hash, written, and the number of shards."""
    shards = max(1, -(-n // SHARD_KEYS))

    def build(rows: pa.Table) -> pa.Table:
        sizes, bits, keys = PerfectHash.build(rows.column("pair").to_numpy())
        return pa.Table.from_batches([rows_out(HASHED, [[rows.column("shard")[0].as_py()], [sizes], [bits], [keys]])])

    sharded = pairs.select("pair", (F.col("place") % shards).cast("int").alias("shard"))
    return freeze(sharded.groupBy("shard").applyInArrow(build, "shard int, sizes array<long>, bits binary, keys binary")), shards


def document_counts(linked: DataFrame, shared) -> np.ndarray:
    """In how many documents each key of the shared hash is linked, in the hash's order."""
    schema = pa.schema([("chunk", pa.int32()), ("part", pa.int64()), ("counts", pa.binary())])
    ddl = "chunk int, part long, counts binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known = shared.value
        n = len(known.keys)
        counts = np.zeros(n, np.int64)
        for batch in slices(batches):
            index = known(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            counts += np.bincount(index[index >= 0], minlength=n)
        part = TaskContext.get().partitionId()
        for at in range(0, n, CHUNK):
            some = counts[at : at + CHUNK]
            if some.any():
                yield rows_out(schema, [[at // CHUNK], [part], [some.astype("<i8").tobytes()]])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype="<i8") for x in rows.column("counts").to_pylist())
        return pa.Table.from_batches([rows_out(schema, [[rows.column("chunk")[0].as_py()], [rows.column("part")[0].as_py()], [total.astype("<i8").tobytes()]])])

    vectors = freeze(linked.mapInArrow(work, ddl))
    while (vectors.agg(F.max("part").alias("last")).first()["last"] or 0) > 0:
        step = vectors.select("chunk", F.floor(F.col("part") / FAN).cast("long").alias("part"), "counts")
        vectors = freeze(step.groupBy("chunk", "part").applyInArrow(add, ddl))
    total = np.zeros(len(shared.value.keys), np.int64)
    for row in vectors.collect():  # as many numbers as one round has keys
        own = np.frombuffer(bytes(row["counts"]), dtype="<i8")
        total[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(own)] = own
    return total


OUT_DDL = "doc_id long, text string, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` for every row of ``docs`` (``doc_id``, ``text``; other columns are ignored).

    Both tokenizers see a space and the text; neither knows special tokens. Bytes where tokens of both end cut them into groups, which ``groups`` lists as
    ``a1,a2|b1;a3|b2``. Links are the pairs of tokens that overlap; ``count_sum`` adds up in how many documents each is linked, ``n_best`` counts
    those with the highest such number of their first id. Texts that are null, empty or that a tokenizer doesn't give back
    have no tokens: zeros, and null ``groups``. Rows with equal or null ids are documents of their own; a text of any
    length is aligned whole. An empty table gives an empty result.
    """
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    linked = linked_pairs(own, path_a, path_b)
    pairs = distinct_pairs(linked)
    hashed, shards = perfect_hash(pairs, pairs.count())
    per_round = max(1, ROUND_KEYS // SHARD_KEYS)
    context, best, rounds = docs.sparkSession.sparkContext, np.zeros(1, np.int64), []
    for low in range(0, shards, per_round):
        rows = hashed.where(F.col("shard").between(low, low + per_round - 1)).orderBy("shard").collect()
        keys = PerfectHash(shards, [(r["shard"], r["sizes"], bytes(r["bits"]), bytes(r["keys"])) for r in rows])
        shared = context.broadcast(keys)
        counts = document_counts(linked, shared)
        a = keys.keys >> A_BITS
        best = np.concatenate([best, np.zeros(max(0, int(a.max(initial=0)) + 1 - len(best)), np.int64)])
        np.maximum.at(best, a, counts)
        rounds.append((shared, context.broadcast(counts)))
    best_of = context.broadcast(best)  # a number for each id of the first vocabulary

    def look_up(shared, counted, first: bool):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            both, known, counts, highest = aligner(path_a, path_b, first), shared.value, counted.value, best_of.value
            for batch in slices(batches, ROWS):
                found = both(column(batch, "text"))
                slots, back = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_inverse=True)
                pairs, per_slot = both.pairs_of(slots)
                index = known(pairs)
                here = index >= 0
                count = np.where(here, counts[index] if len(counts) else 0, 0)
                of_slot = np.repeat(np.arange(len(slots)), per_slot)
                sums = np.zeros((len(slots), 2), np.int64)
                np.add.at(sums, of_slot, np.stack([here & (count == highest[pairs >> A_BITS]), count], axis=1))
                facts = both.facts[slots, :4]
                ends = np.cumsum([len(s) for s in found])
                total = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(np.concatenate([facts, sums], axis=1)[back], axis=0)])
                own = total[ends] - total[ends - [len(s) for s in found]]
                if first:
                    said = [";".join([both.groups[i] for i in s.tolist()]) if len(s) else None for s in found]
                else:
                    before = [column(batch, c) for c in ("n_best", "count_sum", "groups")]
                    own[:, 4] += np.array(before[0], dtype=np.int64)
                    own[:, 5] += np.array(before[1], dtype=np.int64)
                    said = before[2]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(own[:, c]) for c in range(6)], pa.array(said, type=pa.string())],
                                                 names=["doc_id", "text", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

        return work

    state = own
    for i, (shared, counted) in enumerate(rounds):
        state = (freeze(state) if i else state).mapInArrow(look_up(shared, counted, not i), OUT_DDL)
    return state.drop("text")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aligned(table(spark, sf_dir, "documents"), *tokenizer_paths())
    digest = F.coalesce(F.sha2(F.col("groups").cast("binary"), 256), F.lit(""))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
