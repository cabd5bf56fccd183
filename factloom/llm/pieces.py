"""SentencePiece encoding and decoding as a max-plus parallel scan.

For a BPE model a sequence of pieces is the encoding of its text exactly if every two neighbours, encoded on their
own, stay those two pieces: merges cross no border of an encoding, and what happens between two borders does not
depend on the rest. So encoding is a best path in a graph whose nodes are (end, piece) and whose edges weigh 0 where
two pieces stay apart and -inf elsewhere, and every prefix has exactly one best last piece.

A chunk of a giant text maps the states at its start to those at its end by a max-plus matrix. A state at a border is
the piece that holds the last character before it: its end and its id. Matrices combine associatively, from left to
right; going back from the end fixes the state at every border, and each chunk then traces its own path alone.
Within a chunk, runs between hard borders (where no piece can cross) have one state on both sides: a matrix of rank
one. Their paths are remembered, since words repeat.

Models of type BPE with or without byte fallback are read from their file; nothing is trained here.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
SHORT = 64  # characters of a run that is traced from its end
_INF = float("-inf")


class Pieces:
    """A model's pieces and what of their merges a scan needs."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as format_

        proto = format_.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("a BPE model without text normalisation is asked for")
        self.prefix = bool(spec.add_dummy_prefix)
        self.names = [p.piece for p in proto.pieces]
        self.rank: dict[str, tuple[float, int]] = {self.names[i]: (p.score, i) for i, p in enumerate(proto.pieces) if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == 6}
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == 2)
        self.longest = max(map(len, self.rank))
        self.score = {name: score for name, (score, _) in self.rank.items()}
        one = {name: name for name in self.rank}  # each string once, here and where this is sent
        # how a piece comes about: what it begins or ends with before each of its merges, and that merge's score
        self.left: dict[str, tuple[tuple[str, float], ...]] = {}
        self.right: dict[str, tuple[tuple[str, float], ...]] = {}
        for name in list(self.rank):
            first, last, scores = [], [], []
            if self.merge(name, first, last, scores) == [name]:
                self.left[name] = tuple(zip([one.get(x, x) for x in first], scores, strict=True))
                self.right[name] = tuple(zip([one.get(x, x) for x in last], scores, strict=True))
        self.id = {name: self.rank[name][1] for name in self.left}
        ends: dict[str, set[int]] = {}
        for name in self.id:
            if len(name) > 2:
                ends.setdefault(name[-3:], {2, 1}).add(len(name))
        #: lengths of the pieces that may end where these three characters do, longest first; elsewhere 2 and 1
        self.ends = {last: tuple(sorted(lengths, reverse=True)) for last, lengths in ends.items()}
        crossing = any(SPACE in x.lstrip(SPACE) for x in self.id)
        letters = "".join(re.escape(x) for x in self.id if len(x) == 1 and x != SPACE)
        run = f"[{letters}{SPACE}]+" if crossing else f"{SPACE}*[{letters}]+|{SPACE}+"
        self.run = re.compile(f"{run}|.", re.S)

    def merge(self, text: str, first: list[str] | None = None, last: list[str] | None = None, scores: list[float] | None = None) -> list[str]:
        """Best merge first, the leftmost of equals, until none is left. The lists get the pieces at both ends and the next merge's score over time."""
        parts = list(text)
        while True:
            best, at = _INF, -1
            for i in range(len(parts) - 1):
                found = self.score.get(parts[i] + parts[i + 1])
                if found is not None and found > best:
                    best, at = found, i
            if scores is not None:
                first.append(parts[0])
                last.append(parts[-1])
                scores.append(best)
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, a: str, b: str) -> bool:
        """Whether two reachable pieces stay apart.

        Until a merge crosses their border both grow as they do alone, so the two histories are walked in the order
        of their scores; a crossing merge that is better than the next one on both sides ends it.
        """
        score = self.score
        if a + b in score:
            return False
        ends, starts = self.right[a], self.left[b]
        i = j = 0
        x, s = ends[0]
        y, t = starts[0]
        while True:
            crossing = score.get(x + y)
            if crossing is not None and crossing > s and crossing >= t:
                return False
            if s >= t:
                if s == _INF:
                    return True
                i += 1
                x, s = ends[i]
            else:
                j += 1
                y, t = starts[j]


def _path(ids: Sequence[int]) -> bytes:
    return np.array(ids, np.int32).tobytes()


def _ids(path: bytes) -> np.ndarray:
    return np.frombuffer(path, np.int32)


class _Memo(dict):
    """Remembers what `make` gives, in two generations of `most` entries, so that what is in use stays."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = found
        return found


class Scan:
    """Encoding by a Pieces table; remembers what it has found, within bounds.

    A path is the bytes of its ids, four for each: paths are joined without touching single ids.
    """

    def __init__(self, pieces: Pieces, most: int = 160_000):
        self.p = pieces
        self.one = {name: _path([i]) for name, i in pieces.id.items()}
        self.pairs = _Memo(lambda pair: pieces.apart(*[pieces.names[i] for i in _ids(pair)]), most)
        self.runs = _Memo(self._through, most)
        byte = {i: bytes([b]) for b, i in pieces.byte.items()}
        self.raw = pa.array([byte.get(i) or name.replace(SPACE, " ").encode() for i, name in enumerate(pieces.names)], pa.large_binary())

    def rest(self) -> None:
        """Between tasks: forgets the older generation, so that a waiting worker holds little."""
        self.runs.old, self.pairs.old = {}, {}
        common.release()

    def apart(self, a: str | None, b: str | None) -> bool:
        """None is the start of a text, or a character that no piece holds."""
        if a is None or b is None:
            return True
        return self.pairs[self.one[a] + self.one[b]]

    def _run(self, text: str) -> tuple[int, ...]:
        """Ids of the pieces of a run."""
        return tuple(_ids(self._through(text)).tolist())

    def _through(self, text: str) -> bytes:
        """Path through a run between hard borders. That of a short run is a remembered prefix's path and its last piece."""
        known, longest, size = self.one, self.p.longest, len(text)
        if size <= SHORT:
            found = known.get(text)
            if found:
                return found
            if size == 1:
                return self.bytes_of(text)
            for n in self.p.ends.get(text[-3:], (2, 1)):
                last = known.get(text[-n:])
                if last and n < size:
                    path = self.runs[text[:-n]]
                    if self.pairs[path[-4:] + last]:
                        return path + last
            raise ValueError(f"no path through {text!r}")
        ends = [b""] * (len(text) + 1)  # the last piece of each prefix
        sizes = [0] * (len(text) + 1)  # and its characters
        for end in range(1, len(text) + 1):
            for start in range(end - longest if end > longest else 0, end):
                piece = known.get(text[start:end])
                if piece and (not start or self.pairs[ends[start] + piece]):
                    ends[end], sizes[end] = piece, end - start
                    break
        out, at = [], len(text)
        while at:
            out.append(ends[at])
            at -= sizes[at]
        return b"".join(reversed(out))

    def bytes_of(self, char: str) -> bytes:
        """A character that no piece holds: its bytes, or the unknown piece."""
        p = self.p
        return _path([p.byte[b] for b in char.encode()] if len(p.byte) == 256 else [p.unknown])

    def marked(self, text: str) -> str:
        return (SPACE if self.p.prefix else "") + text.replace(" ", SPACE) if text else ""

    def path(self, text: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, self.p.run.findall(self.marked(text))))

    def encode(self, text: str) -> list[int]:
        return _ids(self.path(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        return self.bytes_from(pa.array(ids, pa.int32()), [0, len(ids)])[0].decode("utf-8", "replace")

    def bytes_from(self, ids: pa.Array, at: Sequence[int]) -> list[bytes]:
        """UTF-8 bytes of the texts whose ids lie between each two places of `at`."""
        taken = self.raw.take(ids)
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(ids) + 1)[np.asarray(at)].tolist() if len(ids) else [0] * len(at)
        whole = (taken.buffers()[2] or b"") if len(ids) else b""
        out = [bytes(whole[i:j]) for i, j in pairwise(ends)]
        return [x[1:] if x.startswith(b" ") else x for x in out] if self.p.prefix else out

    # Chunks of a giant text. `at` and `to` are places in `text`, a slice that reaches `longest` characters further on both sides.

    def states(self, text: str, at: int, whole: bool) -> list[tuple[int, str | None]]:
        """(end - at, piece) of all pieces that hold the character before `at`. whole: the text ends at `at`."""
        if at == 0:
            return [(0, None)]
        out: list[tuple[int, str | None]] = []
        known, longest = self.p.id, self.p.longest
        if text[at - 1] not in known:
            return [(0, None)]
        for start in range(max(0, at - longest), at):
            for end in [at] if whole else range(at, min(len(text), start + longest) + 1):
                if text[start:end] in known:
                    out.append((end - at, text[start:end]))
        return out

    def forward(self, text: str, at: int, to: int, entries: list[tuple[int, str | None]], whole: bool):
        """For each (end, piece) node up to the border at `to`: a bit for each entry that reaches it, and one node before it."""
        known, longest = self.p.id, self.p.longest
        nodes: dict[int, dict[str | None, int]] = {}
        back: dict[tuple[int, str | None], tuple[int, str | None]] = {}
        for i, (end, piece) in enumerate(entries):
            nodes.setdefault(at + end, {})
            nodes[at + end][piece] = nodes[at + end].get(piece, 0) | 1 << i
        for place in range(at, to):
            here = nodes.get(place)
            if not here:
                continue
            if text[place] not in known:
                options: list[tuple[int, str | None]] = [(place + 1, None)]
            else:
                ends = range(place + 1, min(len(text), place + longest, to if whole else len(text)) + 1)
                options = [(end, text[place:end]) for end in ends if text[place:end] in known]
            for end, piece in options:
                bits = 0
                for before, reached in here.items():
                    if self.apart(before, piece):
                        if reached & ~bits:
                            back[end, piece] = (place, before)
                        bits |= reached
                if bits:
                    row = nodes.setdefault(end, {})
                    row[piece] = row.get(piece, 0) | bits
        return nodes, back

    def matrix(self, text: str, at: int, to: int, whole: bool) -> np.ndarray:
        """Max-plus matrix from the states at `at` to those at `to`: 0 where a path leads, -inf elsewhere."""
        entries, exits = self.states(text, at, False), self.states(text, to, whole)
        inner = self._inner(text, at, to)
        if inner:  # every path goes through the hard borders: a column of entries times a row of exits
            nodes, _ = self.forward(text, at, inner[0], entries, True)
            alive = 0
            for bits in nodes.get(inner[0], {}).values():
                alive |= bits
            after, _ = self.forward(text, inner[1], to, [(0, None)], whole)
            column = np.array([0 if alive >> i & 1 else _INF for i in range(len(entries))], np.float32)
            row = np.array([0 if after.get(to + end, {}).get(piece, 0) else _INF for end, piece in exits], np.float32)
            return column[:, None] + row[None, :]
        nodes, _ = self.forward(text, at, to, entries, whole)
        out = np.full((len(entries), len(exits)), _INF, np.float32)
        for j, (end, piece) in enumerate(exits):
            bits = nodes.get(to + end, {}).get(piece, 0)
            for i in range(len(entries)):
                if bits >> i & 1:
                    out[i, j] = 0
        return out

    def _inner(self, text: str, at: int, to: int) -> tuple[int, int] | None:
        """First and last hard border that no state at either end of a chunk reaches over, if there are two."""
        ends = [m.end() for m in self.p.run.finditer(text, max(0, at - 1), to)][:-1]
        some = [x for x in ends if at + self.p.longest <= x <= to - self.p.longest]
        return (some[0], some[-1]) if len(some) > 1 else None

    def _back(self, text: str, start: tuple[int, str | None], node: tuple[int, str | None], back: dict) -> list[bytes]:
        out = []
        while node != start:
            before = back[node]
            out.append(self.one[node[1]] if node[1] is not None else self.bytes_of(text[before[0] : node[0]]))
            node = before
        return out[::-1]

    def trace(self, text: str, at: int, to: int, entry: int, exit_: int, whole: bool) -> np.ndarray:
        """Ids of the pieces after the entry state up to the exit state."""
        first, last = self.states(text, at, False)[entry], self.states(text, to, whole)[exit_]
        inner, end = self._inner(text, at, to), (to + last[0], last[1])
        if not inner:
            _, back = self.forward(text, at, to, [first], whole)
            return _ids(b"".join(self._back(text, (at + first[0], first[1]), end, back)))
        nodes, back = self.forward(text, at, inner[0], [first], True)
        (piece,) = nodes[inner[0]]
        out = self._back(text, (at + first[0], first[1]), (inner[0], piece), back)
        out += map(self.runs.__getitem__, self.p.run.findall(text, inner[0], inner[1]))
        _, back = self.forward(text, inner[1], to, [(0, None)], whole)
        return _ids(b"".join(out + self._back(text, (inner[1], None), end, back)))


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def borders(matrices: list[np.ndarray]) -> list[int]:
    """The state at every border of a text, from its chunks' matrices: best forward, then back from the end."""
    best = [np.zeros((1, 1), np.float32)]
    for m in matrices:
        best.append(compose(best[-1], m))
    at = [int(np.argmax(best[-1][0]))]
    for k in range(len(matrices) - 1, -1, -1):
        at.append(int(np.argmax(best[k][0] + matrices[k][:, at[-1]])))
    return at[::-1]


_SCANS: dict[int, Scan] = {}
common.REMEMBERED.append(_SCANS)


def _scan(shared) -> Scan:
    """This worker's scan of a broadcast model."""
    if shared.id not in _SCANS:
        _SCANS.clear()
        common.release()
        _SCANS[shared.id] = Scan(shared.value)
    return _SCANS[shared.id]


class _Shared:
    def __init__(self, spark: SparkSession, model: bytes):
        pieces = Pieces(model)
        self.broadcast = spark.sparkContext.broadcast(pieces)  # of the model's size
        self.id = hash(model)

    @property
    def value(self) -> Pieces:
        return self.broadcast.value


def encode(docs: DataFrame, model_file: str = MODEL, text: str = "text", giant: int = 50_000, chunk: int = 20_000) -> DataFrame:
    """Adds ids (pieces of each text) and round_trip (whether they decode to the text again).

    Texts of over `giant` characters go through the scan in chunks of `chunk` characters, spread over all tasks.
    A null text has null ids and a null round_trip; an empty text has no ids. Repeated rows stay repeated.
    U+2581 decodes to a space, as the format has it. Columns of the names added are replaced.
    """
    spark = docs.sparkSession
    common.bounded(spark)
    with open(model_file, "rb") as f:
        shared = _Shared(spark, f.read())
    docs = docs.drop("ids", "round_trip")
    names = docs.columns
    kind = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    key = common.free(names, "text_key")

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared)
        for batch in batches:
            for some in common.pieces(batch, text, 1 << 20):
                texts = some.column(text).to_pylist()
                paths = [b"" if x is None else scan.path(x) for x in texts]
                at = np.cumsum([0, *[len(x) // 4 for x in paths]], dtype=np.int32)
                flat, none = pa.array(_ids(b"".join(paths))), pa.array([x is None for x in texts], pa.bool_())
                same = [None if x is None else x.encode() == y for x, y in zip(texts, scan.bytes_from(flat, at), strict=True)]
                ids = pa.ListArray.from_arrays(pa.array(at), flat, type=pa.list_(pa.int32()), mask=none)
                yield pa.RecordBatch.from_arrays([*some.columns, ids, pa.array(same, pa.bool_())], [*names, "ids", "round_trip"])
        scan.rest()

    # Giant texts, each once.
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared)
        more = scan.p.longest
        for batch in batches:
            for k, x in zip(batch.column("k"), batch.column("x"), strict=True):
                k, marked = k.as_py(), scan.marked(x.as_py())
                for i, at in enumerate(range(0, len(marked), chunk)):
                    to = min(len(marked), at + chunk)
                    low = max(0, at - more)
                    yield pa.record_batch({"k": pa.array([k]), "n": pa.array([i], pa.int32()), "x": pa.array([marked[low : to + more]]), "at": pa.array([at - low], pa.int32()), "to": pa.array([to - low], pa.int32()), "whole": pa.array([to == len(marked)])})

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared)
        for some in chain.from_iterable(common.pieces(batch, "x", 1 << 20) for batch in batches):
            found = [scan.matrix(r["x"], r["at"], r["to"], r["whole"]) for r in some.to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("k"), some.column("n"), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.tobytes() for m in found], pa.binary())], ["k", "n", "rows", "m"])

    def combine(one: pa.Table) -> pa.Table:
        one = one.sort_by("n")
        found = [np.frombuffer(m, np.float32).reshape(rows, -1) for rows, m in zip(one.column("rows").to_pylist(), one.column("m").to_pylist(), strict=True)]
        at = borders(found)
        return pa.table({"k": one.column("k"), "n": one.column("n"), "entry": pa.array(at[:-1], pa.int32()), "exit": pa.array(at[1:], pa.int32())})

    def traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared)
        for some in chain.from_iterable(common.pieces(batch, "x", 1 << 20) for batch in batches):
            ids = [scan.trace(r["x"], r["at"], r["to"], r["entry"], r["exit"], r["whole"]) for r in some.to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column("k"), some.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["k", "n", "part"])
        scan.rest()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = _scan(shared)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids = row.column("ids")[0].values
                same = scan.bytes_from(ids, [0, len(ids)]) == [row.column(text)[0].as_py().encode()]
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in [*names, "ids"]], pa.array([same], pa.bool_())], [*names, "ids", "round_trip"])

    size = F.coalesce(F.length(text), F.lit(0))
    big = docs.where(size > giant).withColumn(key, F.sha2(text, 256))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    chunks = big.groupBy(F.col(key).alias("k")).agg(F.first(text).alias("x")).mapInArrow(split, "k string, n int, x string, at int, to int, whole boolean").repartition(parts, "k", "n")
    at = chunks.mapInArrow(matrices, "k string, n int, rows int, m binary").groupBy("k").applyInArrow(combine, "k string, n int, entry int, exit int")
    traced = chunks.join(at, ["k", "n"]).mapInArrow(traces, "k string, n int, part array<int>")
    # one row of a text holds its ids as it holds the text
    whole = traced.groupBy("k").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"])).alias("ids")).withColumnRenamed("k", key)
    large = big.join(whole, key).select(*names, "ids").mapInArrow(check, kind)
    return docs.where(size <= giant).mapInArrow(small, kind).unionByName(large)


def sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: pieces of every document, and whether they decode to it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")
