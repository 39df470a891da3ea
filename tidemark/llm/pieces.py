"""SentencePiece BPE ids by a max-plus parallel scan, and texts back from ids.

A BPE model's ids are the one path through the lattice of its pieces on which every two neighbours are
compatible, that is, on which merging the two pieces' characters by the model's scores gives these two pieces back.  With weight
0 for a compatible step and minus infinity for any other, encoding is a shortest-path problem over
(max, +), and that is what is computed here; a text's last piece at each place is unique, so a step is a look-up.

A text longer than ``GIANT`` characters is cut into chunks anywhere.  The state at a cut is the piece that reaches
it or lies over it, and how much of it lies before.  Each chunk yields a transfer matrix from the states at
its first cut to those at its last, a task of its own.  Matrices are combined associatively, ``BLOCK`` neighbours to a row, in rounds until a text has one; on
the way back each block, told its first and last state, tells its members theirs; then each chunk finds its own ids, again in a task of its
own.  The digests of a text are made of its chunks one after the other; no row and no task ever holds all of a giant text but the one that cuts it.

No piece holds a space after another character, so words are independent, and a worker keeps the
ids of words that it has met.  Characters without a piece become bytes.

Defined results: a null text is an empty one and has no ids; the sign U+2581 is read as a space, as the model does; repeated
rows repeat their result; ids may be null; an empty table gives no rows; other columns are ignored.  Giant texts are told apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.durable import cut
from tidemark.llm.frames import KEPT, batch_of, groups_of, id_text, mapped, utf8_slices

GIANT = 32_768
CHUNK = 16_384
#: Matrices that are combined in one row.
BLOCK = 64
SPACE = "▁"
KEPT_WORDS = 1_200_000
KEPT_LENGTH = 64
GROUP_BYTES = 1 << 20
STOPS = ".,"
UNKNOWN, BEGIN, END = -1, -2, -3
RESULT = "doc_id long, n_chars long, n_ids long, ids_crc32 long, n_chunks int, decoded_sha256 string"

State = tuple[int, int]


class Pieces:
    """The vocabulary and the merging rules of one model."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))]
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.rank = {self.names[i]: model.get_score(i) for i in plain}
        self.ids = {self.names[i]: i for i in plain}
        self.longest = max(map(len, self.ids))
        self.bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.plain_bytes = [self.names[i].replace(SPACE, " ").encode() if i in self.rank or self.names[i] in self.ids else b"" for i in range(n)]
        for b, i in enumerate(self.bytes):
            self.plain_bytes[i] = bytes([b])
        self.fits: dict[tuple[int, int], bool] = {}
        # a piece that merging never makes of its own characters is in no path
        self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self.merged(p) == [p]}
        #: Every beginning of a piece: the piece's id, or -1 if it is only a beginning.
        self.starts = {p[:n]: -1 for p in self.ids for n in range(1, len(p))} | self.ids
        #: Neighbouring signs within any piece: between others no merge is possible.
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merging by score, the leftmost of equals first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.rank.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        if left < 0 or right < 0:
            return True
        known = self.fits.get((left, right))
        if known is None:
            a, b = self.names[left], self.names[right]
            known = self.fits[left, right] = self.merged(a + b) == [a, b]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
        return known

    def steps(self, text: str, first: int, before: int, stop: int) -> list[tuple[int, int] | None]:
        """For each place from first to stop the last piece of the path there and its length; None where no path ends.

        before: the piece that ends at first.
        """
        last: list[tuple[int, int] | None] = [None] * (stop - first + 1)
        last[0] = (before, 0)
        starts, fits, compatible = self.starts, self.fits, self.compatible
        for at in range(first, stop):
            here = last[at - first]
            if here is None:
                continue
            left = here[0]
            for end in range(at + 1, stop + 1):
                piece = starts.get(text[at:end])
                if end == at + 1 and (piece is None or piece < 0) and last[end - first] is None:
                    last[end - first] = (UNKNOWN, 1)
                if piece is None:
                    break
                if piece >= 0 and last[end - first] is None:
                    fit = fits.get((left, piece))
                    if compatible(left, piece) if fit is None else fit:
                        last[end - first] = (piece, end - at)
        return last

    def out(self, piece: int, text: str, start: int) -> list[int]:
        return [piece] if piece >= 0 else [self.bytes[b] for b in text[start].encode("utf-8", "surrogatepass")]

    def back(self, last: list[tuple[int, int] | None], text: str, first: int, end: int) -> list[int]:
        """Ids of the path from first to end."""
        found = []
        while end > first:
            piece, size = last[end - first]
            end -= size
            found.append(self.out(piece, text, end))
        return [i for ids in reversed(found) for i in ids]

    def word(self, text: str) -> bytes:
        """Ids of a word with its spaces before it, on its own; parts between which no merge is possible on their own again."""
        found = self.words.get(text)
        if found is None:
            cut = len(text.rstrip(STOPS))
            if 0 < cut < len(text) and text[cut - 1 : cut + 1] not in self.pairs:
                found = self.word(text[:cut]) + self.word(text[cut:])
            else:
                ids = self.back(self.steps(text, 0, BEGIN, len(text)), text, 0, len(text))
                found = np.asarray(ids, "<i4").tobytes()
            if len(text) <= KEPT_LENGTH:
                if len(self.words) >= KEPT_WORDS:
                    self.words.clear()
                self.words[text] = found
        return found

    def whole(self, text: str) -> bytes:
        """Ids of a text that begins with its first word's spaces."""
        get, word = self.words.get, self.word
        out = []
        for i, line in enumerate(text.split("\n")):
            if i:
                out.append(self.newline)
            parts = words_of(line)
            found = list(map(get, parts))
            if None in found:
                found = [f if f is not None else word(p) for f, p in zip(found, parts, strict=True)]
            out += found
        return b"".join(out)

    @property
    def newline(self) -> bytes:
        return self.word("\n")

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids; the space that encoding puts first goes."""
        return b"".join(map(self.plain_bytes.__getitem__, ids.tolist())).removeprefix(b" ")


def words_of(line: str) -> list[str]:
    """Words with the spaces before them; spaces at the end are a word."""
    head, *rest = line.split(SPACE)
    words = [head] if head else []
    if "" not in rest:
        return words + [SPACE + w for w in rest]
    held = ""
    for w in rest:
        held += SPACE
        if w:
            words.append(held + w)
            held = ""
    return words + [held] if held else words


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def breaks(text: str, first: int, stop: int) -> list[int]:
    """Places from first to stop at which a word begins after another one."""
    found, at = [], text.find(SPACE, max(first, 1), stop)
    while at >= 0:
        if text[at - 1] != SPACE:
            found.append(at)
        at = text.find(SPACE, at + 1, stop)
    return found


class Chunk:
    """Characters [lo, hi) of a text, with up to ``longest`` more on both sides in around."""

    def __init__(self, pieces: Pieces, around: str, lo: int, hi: int, first: bool, final: bool) -> None:
        self.pieces, self.text, self.lo, self.hi, self.first, self.final = pieces, around, lo, hi, first, final
        self.breaks = breaks(around, lo, hi)

    def at_cut(self, at: int) -> list[State]:
        """States at a cut: pieces that end there or lie over it."""
        found: list[State] = []
        text, ids = self.text, self.pieces.ids
        for before in range(1, min(self.pieces.longest, at) + 1):
            for size in range(before, min(self.pieces.longest, len(text) - at + before) + 1):
                piece = ids.get(text[at - before : at - before + size])
                if piece is not None:
                    found.append((piece, before))
        if text[at - 1] not in ids:
            found.append((UNKNOWN, 1))
        return found

    def ins(self) -> list[State]:
        return [(BEGIN, 0)] if self.first else self.at_cut(self.lo)

    def outs(self) -> list[State]:
        return [(END, 0)] if self.final else self.at_cut(self.hi)

    def enter(self, state: State) -> tuple[int, int]:
        """Where the piece of a state ends, and the piece."""
        piece, before = state
        size = 1 if piece == UNKNOWN else 0 if piece == BEGIN else len(self.pieces.names[piece])
        return self.lo + size - before, piece

    def reached(self, last: list[tuple[int, int] | None], first: int, state: State) -> bool:
        piece, before = state
        end = self.hi - before
        if end < first or last[end - first] is None:
            return False
        return piece == END or self.pieces.compatible(last[end - first][0], piece)

    def matrix(self) -> tuple[list[State], list[State], np.ndarray]:
        """Weights (0 or minus infinity) from each state at the first cut to each at the last."""
        ins, outs = self.ins(), self.outs()
        weights = np.full((len(ins), len(outs)), -np.inf)
        tail = None
        for i, state in enumerate(ins):
            at, piece = self.enter(state)
            meet = next((b for b in self.breaks if b >= at), None)
            last = self.pieces.steps(self.text, at, piece, self.hi if meet is None else meet)
            if meet is None:
                reach = np.array([self.reached(last, at, o) for o in outs])
            elif last[-1] is None:
                continue
            else:
                if tail is None:
                    c = self.breaks[-1]
                    end = self.pieces.steps(self.text, c, BEGIN, self.hi)
                    tail = np.array([self.reached(end, c, o) for o in outs])
                reach = tail
            weights[i, reach] = 0
        return ins, outs, weights

    def path(self, enter: State, leave: State) -> bytes:
        """Ids of the pieces that begin in the chunk, on the path between two states."""
        at, piece = self.enter(enter)
        meets = [b for b in self.breaks if b >= at]
        ids = b""
        if meets:
            last = self.pieces.steps(self.text, at, piece, meets[0])
            ids = np.asarray(self.pieces.back(last, self.text, at, meets[0]), "<i4").tobytes()
            ids += self.pieces.whole(self.text[meets[0] : meets[-1]])
            at, piece = meets[-1], BEGIN
        last = self.pieces.steps(self.text, at, piece, self.hi)
        end = self.hi - leave[1]
        tail = self.pieces.back(last, self.text, at, end)
        if leave[0] != END:
            tail += self.pieces.out(leave[0], self.text, end)
        return ids + np.asarray(tail, "<i4").tobytes()


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; associative."""
    return (a[:, :, None] + b[None]).max(axis=1)


def prefixes(items: list, join: Callable) -> list:
    """All products of the first items, in a number of rounds that grows with the logarithm of theirs."""
    if len(items) < 2:
        return list(items)
    half = prefixes([join(items[i], items[i + 1]) for i in range(0, len(items) - 1, 2)], join)
    out = [items[0]]
    for i in range(1, len(items)):
        out.append(half[i // 2] if i % 2 else join(half[i // 2 - 1], items[i]))
    return out


def states_on_path(states: list[list[State]], matrices: list[np.ndarray], enter: State | None = None, leave: State | None = None) -> list[State]:
    """The state at each cut, first and last included, of the best path between two states (of the first and last, if not given)."""
    first = states[0].index(enter) if enter is not None else 0
    last = states[-1].index(leave) if leave is not None else 0
    before = prefixes([matrices[0][first : first + 1], *matrices[1:]], compose)
    after = [m.T for m in prefixes([m.T for m in reversed([*matrices[:-1], matrices[-1][:, last : last + 1]])], compose)][::-1]
    chosen = [states[0][first]]
    for k in range(1, len(states) - 1):
        total = before[k - 1][0] + after[k][:, 0]
        if not np.isfinite(total).any():
            raise ValueError("no path through the lattice")
        chosen.append(states[k][int(np.argmax(total))])
    return [*chosen, states[-1][last]]


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


KEPT["pieces"] = pieces_of.cache_clear


def encode(text: str, path: str, chunk: int | None = None) -> np.ndarray:
    """The ids of a text; with chunk by the scan, in this process."""
    pieces, text = pieces_of(path), normal(text)
    if not chunk or len(text) <= chunk:
        return np.frombuffer(pieces.whole(text), "<i4")
    parts = [Chunk(pieces, *part[1:]) for part in chunks_of(text, chunk, pieces.longest)]
    found = [p.matrix() for p in parts]
    path_states = states_on_path([f[0] for f in found] + [found[-1][1]], [f[2] for f in found])
    return np.frombuffer(b"".join(p.path(a, b) for p, a, b in zip(parts, path_states[:-1], path_states[1:], strict=True)), "<i4")


def chunks_of(text: str, size: int, around: int) -> list[tuple[int, str, int, int, bool, bool]]:
    """(number, text around, lo, hi, first, final) of each chunk; the last is not shorter than a piece can be, if there are others."""
    cuts = list(range(0, len(text), size))
    if len(cuts) > 1 and len(text) - cuts[-1] < around:
        cuts.pop()
    out = []
    for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(text)], strict=True)):
        left = max(0, a - around)
        out.append((k, text[left : b + around], a - left, b - left, a == 0, b == len(text)))
    return out


def result_of(ids: bytes, n_chars: int, n_chunks: int, pieces: Pieces) -> tuple:
    decoded = pieces.decode(np.frombuffer(ids, "<i4"))
    return n_chars, len(ids) // 4, zlib.crc32(ids), n_chunks, hashlib.sha256(decoded).hexdigest()


def result_batch(doc_id: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    names = ("n_chars", "n_ids", "ids_crc32", "n_chunks", "decoded_sha256")
    return batch_of(doc_id=doc_id, **{n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})


def small_texts(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(path)
        for batch in batches:
            raw, at = utf8_slices(batch.column("text"))
            rows = []
            for i in range(batch.num_rows):
                text = raw[at[i] : at[i + 1]].tobytes().decode()
                rows.append(result_of(pieces.whole(normal(text)), len(text), 1, pieces))
            yield result_batch(batch.column("doc_id"), rows)

    return mapped(docs, run, RESULT, keeps="pieces")


def _pairs(flat: list[int]) -> list[State]:
    return list(zip(flat[::2], flat[1::2], strict=True))


def _flat(states: list[State]) -> list[int]:
    return [x for s in states for x in s]


def _members(parts: list[dict]) -> tuple[list[list[State]], list[np.ndarray]]:
    """States at all cuts of some neighbours, and their matrices."""
    states = [_pairs(p["ins"]) for p in parts] + [_pairs(parts[-1]["outs"])]
    return states, [np.where(np.array(p["open"], bool).reshape(len(a), len(b)), 0.0, -np.inf) for p, a, b in zip(parts, states[:-1], states[1:], strict=True)]


def _by_rows(f: Callable[[dict], list[dict]], schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([x for i in range(batch.num_rows) for x in f(batch.slice(i, 1).to_pylist()[0])], schema)

    return run


def giant_texts(docs: DataFrame, path: str) -> DataFrame:
    """RESULT for texts cut into chunks; equal texts are encoded once."""
    text = ["h1", "h2"]
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
    keyed = hashed.groupBy(*text).agg(F.first("text").alias("text"))

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longest = pieces_of(path).longest
        for batch in batches:
            for i in range(batch.num_rows):
                parts = chunks_of(normal(batch.column("text")[i].as_py()), CHUNK, longest)
                for a, b in groups_of(np.array([len(p[1]) for p in parts]), 4 * GROUP_BYTES):
                    columns = list(zip(*parts[a:b], strict=True))
                    names = ("k", "around", "lo", "hi", "first", "final")
                    types = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
                    whose = {n: pa.array([batch.column(n)[i].as_py()] * (b - a), pa.int64()) for n in text}
                    yield batch_of(**whose, **{n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    def transfer(r: dict) -> list[dict]:
        ins, outs, weights = Chunk(pieces_of(path), r["around"], r["lo"], r["hi"], r["first"], r["final"]).matrix()
        return [{"h1": r["h1"], "h2": r["h2"], "k": r["k"], "ins": _flat(ins), "outs": _flat(outs), "open": np.isfinite(weights).ravel().tolist()}]

    def combine(r: dict) -> list[dict]:
        states, matrices = _members(r["parts"])
        whole = matrices[0]
        for m in matrices[1:]:
            whole = compose(whole, m)
        return [{"h1": r["h1"], "h2": r["h2"], "k": r["k"], "ins": _flat(states[0]), "outs": _flat(states[-1]), "open": np.isfinite(whole).ravel().tolist()}]

    def choose(r: dict) -> list[dict]:
        states, matrices = _members(r["parts"])
        found = states_on_path(states, matrices, tuple(r["enter"]), tuple(r["leave"]))
        return [{"h1": r["h1"], "h2": r["h2"], "k": p["k"], "enter": list(a), "leave": list(b)} for p, a, b in zip(r["parts"], found[:-1], found[1:], strict=True)]

    def backtrace(r: dict) -> list[dict]:
        ids = Chunk(pieces_of(path), r["around"], r["lo"], r["hi"], r["first"], r["final"]).path(tuple(r["enter"]), tuple(r["leave"]))
        return [{"h1": r["h1"], "h2": r["h2"], "k": r["k"], "ids": ids}]

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text of rows (h1, h2, k, ids) in order."""
        pieces = pieces_of(path)
        name, n, crc, chunks, digest, begun = None, 0, 0, 0, hashlib.sha256(), False

        def row() -> pa.RecordBatch:
            one = [{"h1": name[0], "h2": name[1], "n_ids": n, "ids_crc32": crc, "n_chunks": chunks, "decoded_sha256": digest.hexdigest()}]
            return pa.RecordBatch.from_pylist(one, DIGEST_TYPE)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in text), strict=True))
            for i, key in enumerate(keys):
                if key != name:
                    if name is not None:
                        yield row()
                    name, n, crc, chunks, digest, begun = key, 0, 0, 0, hashlib.sha256(), False
                ids = batch.column("ids")[i].as_py()
                found = b"".join(map(pieces.plain_bytes.__getitem__, np.frombuffer(ids, "<i4").tolist()))
                digest.update(found if begun else found.removeprefix(b" "))
                begun = begun or bool(found)
                n, crc, chunks = n + len(ids) // 4, zlib.crc32(ids, crc), chunks + 1
        if name is not None:
            yield row()

    def blocks(level: DataFrame) -> DataFrame:
        by = [*text, (F.col("k") / BLOCK).cast("int").alias("block")]
        return level.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "ins", "outs", "open"))).alias("parts")).withColumnRenamed("block", "k")  # BLOCK rows at most

    chunks = cut(mapped(keyed, split, "h1 long, h2 long, k int, around string, lo int, hi int, first boolean, final boolean", keeps="pieces").repartition(*text, "k"))
    levels = [cut(mapped(chunks, _by_rows(transfer, TRANSFER_TYPE), TRANSFER, keeps="pieces"))]
    while (levels[-1].agg(F.max("k")).first()[0] or 0) > 0:
        levels.append(cut(mapped(blocks(levels[-1]), _by_rows(combine, TRANSFER_TYPE), TRANSFER, keeps="pieces")))
    states = levels[-1].select(*text, "k", F.col("ins").alias("enter"), F.col("outs").alias("leave"))
    for level in reversed(levels[:-1]):
        states = cut(mapped(blocks(level).join(states, [*text, "k"]), _by_rows(choose, STATE_TYPE), "h1 long, h2 long, k int, enter array<int>, leave array<int>", keeps="pieces"))
    found = mapped(chunks.join(states, [*text, "k"]), _by_rows(backtrace, IDS_TYPE), "h1 long, h2 long, k int, ids binary", keeps="pieces")
    whole = mapped(found.repartition(*text).sortWithinPartitions(*text, "k"), digests, "h1 long, h2 long, n_ids long, ids_crc32 long, n_chunks int, decoded_sha256 string", keeps="pieces")
    light = hashed.select("doc_id", *text, F.length("text").cast("long").alias("n_chars"))
    return light.join(whole, text).select("doc_id", "n_chars", "n_ids", "ids_crc32", "n_chunks", "decoded_sha256")


_WHOSE = [("h1", pa.int64()), ("h2", pa.int64())]
_STATES = pa.list_(pa.int32())
TRANSFER = "h1 long, h2 long, k int, ins array<int>, outs array<int>, open array<boolean>"
TRANSFER_TYPE = pa.schema([*_WHOSE, ("k", pa.int32()), ("ins", _STATES), ("outs", _STATES), ("open", pa.list_(pa.bool_()))])
STATE_TYPE = pa.schema([*_WHOSE, ("k", pa.int32()), ("enter", _STATES), ("leave", _STATES)])
IDS_TYPE = pa.schema([*_WHOSE, ("k", pa.int32()), ("ids", pa.binary())])
DIGEST_TYPE = pa.schema([*_WHOSE, ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("n_chunks", pa.int32()), ("decoded_sha256", pa.string())])


def encoded(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_ids, ids_crc32, n_chunks, decoded_sha256 for every row."""
    docs = id_text(df, id_col, text_col)
    return small_texts(docs.where(F.length("text") <= GIANT), path).unionByName(giant_texts(docs.where(F.length("text") > GIANT), path))
