"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly, by backtracking.

No merge queue runs over a text. A text is cut before each space that follows something else, where
no piece can reach across (checked against the vocabulary), and each distinct segment of a slice,
told apart by its bytes, is encoded once, a short one once per worker: an Aho-Corasick automaton gives the pieces that start at each character, the longest
is taken first, two neighbours are compatible if merging their joined characters afresh gives them
back, a dead end goes back to the next shorter piece, and a bit per position remembers where no way
on was found. Characters without a piece become byte pieces. Whole texts are then put together from
the segments' ids with numpy, and decoded from the ids alone.

Only the model's bytes (its size is checked) go to the executors. A worker remembers at most
`cache_segments` segments of at most `_CACHED_BYTES` bytes, and nothing of longer ones. Texts are
never shuffled.

Defined results: a null text counts as empty and encodes to the begin and end ids; a null id is kept;
columns besides the id and the text are ignored. Models with user-defined symbols, other than
identity normalisation, or another type than BPE are refused.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import _text as X

MARK = "▁"
MODEL_BYTES_MOST = 64 << 20
_CACHED_BYTES = 48
_MARK_BYTES = MARK.encode()


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Codec:
    """One model's vocabulary with the encoder, the decoder and their memory. by_library: new segments
    are encoded by the sentencepiece library, for callers that only need ids."""

    def __init__(self, model: bytes, cache_segments: int = 200_000, by_library: bool = False):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        self.library = library if by_library else None
        self.bos, self.eos, self.unknown = library.bos_id(), library.eos_id(), library.unk_id()
        pieces = [library.id_to_piece(i) for i in range(n)]
        self.byte_ids = {}
        self.score, self.text = {}, {}
        surfaces = []
        for i, piece in enumerate(pieces):
            if library.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                surfaces.append(bytes([int(piece[3:5], 16)]))
            elif library.is_control(i):
                surfaces.append(b"")
            elif library.is_unknown(i):
                surfaces.append(" ⁇ ".encode())
            else:
                self.score[piece], self.text[i] = (library.get_score(i), i), piece
                surfaces.append(piece.replace(MARK, " ").encode())
        if len(self.byte_ids) not in (0, 256):
            raise ValueError("a model needs all byte pieces or none")
        self.by_text = {t: i for i, t in self.text.items()}
        self.characters = {c for t in self.text.values() for c in t}
        self.can_cut = not any(a != MARK and b == MARK for t in self.text.values() for a, b in zip(t, t[1:]))
        self.valid: dict[int, bool] = {}
        automaton = ahocorasick.Automaton()
        for i, t in self.text.items():
            if len(t) == 1 or self._merge(t) == [i]:  # a piece that no merge makes is never chosen
                automaton.add_word(t, (len(t), i))
        automaton.make_automaton()
        self.automaton = automaton
        self.cache_segments = cache_segments
        self._forget()
        sizes = np.array([len(s) for s in surfaces], np.int64)
        self.surface_size = sizes
        self.surface_at = np.cumsum(sizes) - sizes
        self.surface = np.frombuffer(b"".join(surfaces) + b"\0", np.uint8)
        self.spaced = np.array([s[:1] == b" " and i in self.text for i, s in enumerate(surfaces)])
        probe = " A é　 b\n▁x\x00 \U0001f600  "
        if self.encode(probe) != library.encode(probe, add_bos=True, add_eos=True):
            raise ValueError("not a BPE model with identity normalisation and a dummy prefix")

    def _forget(self) -> None:
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _merge(self, text: str) -> list[int]:
        """Ids of a short text by merging: always the pair of the best score, the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if at < 0:
                return [self.by_text.get(p, -1) for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self.valid.get(key)
        if found is None:
            if len(self.valid) > 250_000:
                self.valid.clear()
            found = self.valid[key] = self._merge(self.text[left] + self.text[right]) == [left, right]
        return found

    def _backtrack(self, text: str) -> list[int]:
        """Ids of a text whose characters all have pieces."""
        n = len(text)
        starts: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            starts[end + 1 - match[0]].append(match)  # by rising length
        valid, compatible = self.valid, self._compatible
        chosen: list[tuple[int, int, int]] = []  # length, id, index among those that start there
        failed = 0
        at, index, before = 0, len(starts[0]) - 1, -1
        while at < n:
            options = starts[at]
            while index >= 0:
                length, piece = options[index]
                if not failed >> (at + length) & 1 and (before < 0 or (known if (known := valid.get(before << 32 | piece)) is not None else compatible(before, piece))):
                    break
                index -= 1
            if index >= 0:
                chosen.append((length, piece, index))
                at += length
                before = piece
                if at < n:
                    index = len(starts[at]) - 1
            else:
                failed |= 1 << at
                length, _, index = chosen.pop()
                at -= length
                index -= 1
                before = chosen[-1][1] if chosen else -1
        return [c[1] for c in chosen]

    def segment(self, text: str) -> list[int]:
        """Ids of a text in which spaces are marks already."""
        if self.characters.issuperset(text):
            return self._backtrack(text)
        out, run = [], []
        for c in text + "\0":
            if c in self.characters and c != "\0":
                run.append(c)
                continue
            if run:
                out += self._backtrack("".join(run))
                run = []
            out += [self.byte_ids.get(b, self.unknown) for b in c.encode()]
        last = out[: len(out) - 1]
        if "\0" in self.characters:  # pragma: no cover - no such vocabulary is known
            raise ValueError("a vocabulary with a zero character")
        return last

    def encode(self, text: str) -> list[int]:
        ids, ends = self.encode_slice(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        return ids.tolist()

    def _ids_of(self, segments: list[bytes]) -> list[bytes]:
        """The ids of each (distinct) segment, as 32-bit numbers."""
        if len(self.known) > self.cache_segments // 2:  # what is used goes on from the older half
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        found = [known.get(s) or older.get(s) for s in segments]
        new = [i for i, ids in enumerate(found) if ids is None]
        if older:
            known.update((s, ids) for s, ids in zip(segments, found) if ids is not None and len(s) <= _CACHED_BYTES)
        if self.library:
            self._by_library(new, segments, found)
        for i in new:
            if found[i] is None:
                found[i] = array("i", self.segment(segments[i].decode().replace(" ", MARK))).tobytes()
            if len(segments[i]) <= _CACHED_BYTES:
                known[segments[i]] = found[i]
        return found

    def _by_library(self, new: list[int], segments: list[bytes], found: list) -> None:
        """Ids of the new segments, encoded together; the library puts the first space back. Those of
        spaces alone are left out."""
        new = [i for i in new if segments[i].strip(b" ")]
        for i, ids in zip(new, self.library.encode([segments[i].decode()[1:] for i in new], num_threads=1)):
            found[i] = array("i", ids).tobytes()

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice one after the other, with begin and end ids, and each end."""
        rows = len(offsets) - 1
        size = np.diff(offsets)
        filled = size > 0
        # one space before each text that isn't empty
        shift = np.cumsum(filled)
        spaced = np.full(len(data) + int(shift[-1]) if rows else 0, 0x20, np.uint8)
        spaced[np.arange(len(data)) + np.repeat(shift, size)] = data
        first = (offsets[:-1] + shift - filled)[filled]
        space = spaced == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        if not self.can_cut:
            begins[:] = False
        mark = np.frombuffer(_MARK_BYTES, np.uint8)  # a mark in the text itself joins the spaces after it
        marks = np.flatnonzero((spaced[:-3] == mark[0]) & (spaced[1:-2] == mark[1]) & (spaced[2:-1] == mark[2])) if len(spaced) > 3 else np.empty(0, np.int64)
        begins[marks + 3] = False
        begins[first] = True
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(spaced)] if len(starts) else starts
        which, segments = X.distinct(spaced, starts, ends)
        ids = self._ids_of(segments.to_pylist())
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        pool = np.frombuffer(b"".join(ids), np.int32)
        count, place = sizes[which], (np.cumsum(sizes) - sizes)[which]
        row = np.searchsorted(np.append(first, len(spaced)), starts, side="right") - 1
        row = np.flatnonzero(filled)[row] if len(row) else row
        total = int(count.sum())
        put = np.cumsum(count) - count
        out = np.empty(total + 2 * rows, np.int32)
        per_row = np.bincount(row, weights=count, minlength=rows).astype(np.int64) + 2 if rows else np.empty(0, np.int64)
        stop = np.cumsum(per_row)
        out[stop - per_row] = self.bos
        out[stop - 1] = self.eos
        within = np.arange(total)
        out[within + np.repeat(2 * row + 1, count)] = pool[within + np.repeat(place - put, count)]
        return out, stop

    def decode_slice(self, ids: np.ndarray, stop: np.ndarray) -> list[bytes]:
        """The texts of ids: surfaces joined, the first text piece without its leading space."""
        size, at = self.surface_size[ids], self.surface_at[ids]
        begin = np.r_[0, stop[:-1]]
        shown = np.flatnonzero(size > 0)
        first = np.searchsorted(shown, begin)
        first = shown[first[first < len(shown)]] if len(shown) else shown
        row = np.searchsorted(stop, first, side="right")
        first = first[(first >= begin[row]) & self.spaced[ids[first]]] if len(first) else first
        first = np.unique(first)
        size[first] -= 1
        at[first] += 1
        total = int(size.sum())
        put = np.cumsum(size) - size
        data = self.surface[np.arange(total) + np.repeat(at - put, size)].tobytes()
        edge = np.r_[0, np.cumsum(size)][np.r_[0, stop]]
        return [data[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]


_codecs: dict[int, Codec] = {}


def codec_of(model: bytes, cache_segments: int, by_library: bool = False) -> Codec:
    """The worker's codec; one model is kept."""
    key = hash((model, cache_segments, by_library))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(model, cache_segments, by_library)
    return _codecs[key]


def _text_of(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:  # each byte that is no UTF-8 counts as one replacement
        return "".join(c if not "\udc80" <= c <= "\udcff" else "�" for c in raw.decode(errors="surrogateescape"))


def encode_and_decode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", cache_segments: int = 200_000) -> DataFrame:
    """id_col, n_tokens, ids (little-endian unsigned 32-bit, with begin and end ids) and decoded (the
    text of those ids)."""
    with open(model_path or default_model_path(), "rb") as f:
        model = f.read()
    if len(model) > MODEL_BYTES_MOST:
        raise ValueError(f"the model has {len(model)} bytes; at most {MODEL_BYTES_MOST} are sent to executors")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        codec = codec_of(shared.value, cache_segments)
        for batch in batches:
            for first, data, offsets in X.slices(batch.column(1)):
                ids, stop = codec.encode_slice(data, offsets)
                texts = codec.decode_slice(ids, stop)
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stop), [None, pa.py_buffer(np.r_[0, stop * 4].astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(stop)), pa.array(np.diff(np.r_[0, stop]), pa.int64()), packed.cast(pa.binary()), pa.array([_text_of(t) for t in texts], pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    return X.bounded_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)
