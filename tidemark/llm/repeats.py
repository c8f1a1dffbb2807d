"""Long repeated passages, exactly, without comparing documents with each other.

A text is a sequence of symbols (bytes, or words), a window is `length` consecutive symbols of one
text, and the question is which windows also occur elsewhere. Three exchanges of packed arrays
answer it, and no step holds more than one bounded share of the corpus:

1. A rolling hash marks triggers: a gram of `gram` symbols whose hash is smallest in some window. Each
   window belongs to one, the first of its smallest grams, which depends on the window's content only,
   so a repeated window has a repeated trigger. Each chunk of documents sends its distinct
   trigger fingerprints to buckets; a bucket answers with those seen more than once.
2. For repeated triggers a chunk sends the phrase around each (the symbols of the trigger's windows),
   once per distinct phrase, to the trigger's bucket. The bucket's dictionary of phrases gives the equal windows. A trigger with very
   many occurrences (a licence line in a third of the documents) is hot: its windows are dealt out
   by their own hash, one row per distinct window and chunk, so no bucket gathers its contexts.
3. The spans found go back to the chunks, which cut them out of the texts.

Triggers only nominate. Phrases are equal if their symbols are; windows of hot triggers if 128-bit
hashes of their symbols are (among n of them a chance agreement has a probability of n * n / 2**129).
Words are symbols by a 64-bit hash, so windows of words agree by chance only if all their words do.

The text is measured first: chunks and buckets are shares of a given size, whatever the size of the
corpus and the session's settings, and each has a partition of its own. Messages are
aggregated before each exchange, at most one of a kind from a chunk to a bucket, so a passage in a
third of all documents is one row per chunk. Documents are dealt out by a hash of id and text; no link,
pair or fingerprint list reaches the driver.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import _text as X

SPACE_OR_CONTROL = X.byte_class(0x20, (0x09, 0x0D))
#: A trigger with more occurrences than this is dealt out by window.
HOT_TRIGGER = 200
SYMBOLS_AT_ONCE = 3 << 20
#: Text of a chunk. A task holds one chunk, or the messages of one bucket, which are about as large as
#: CHUNKS_A_BUCKET chunks; larger chunks on larger executors make fewer, fuller messages.
CHUNK_BYTES = 8 << 20
CHUNKS_A_BUCKET = 2

_COUNTED = np.dtype([("fp", "<u4"), ("n", "u1")])
_SPAN = np.dtype([("row", "<i4"), ("start", "<i4"), ("end", "<i4")])
_WINDOW = np.dtype([("hash", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("pos", "<i4"), ("n", "u1")])

_MESSAGE = "bucket int, chunk int, kind int, blob binary"
_PHRASES, _WINDOWS, _SPANS = 0, 1, 2


@dataclass(frozen=True)
class Rule:
    """length: symbols of a window; gram: symbols of a trigger; words: symbols are words, not bytes;
    earlier: only a window of a document with a smaller id counts as a repeat, else any other place; key:
    of the hashes, drawn anew for each run, so that no text can be made to collide in it."""

    length: int
    gram: int
    words: bool
    earlier: bool
    key: int = field(default_factory=lambda: secrets.randbits(63))

    @property
    def context(self) -> int:
        return 2 * self.length - self.gram

    @property
    def phrase(self) -> np.dtype:
        offset = "u1" if self.length <= 256 else "<u2" if self.length <= 65_536 else "<u4"
        return np.dtype([("fp", "<u4"), ("doc", "<i8"), ("row", "<i4"), ("pos", "<i4"), ("lo", offset), ("hi", offset), ("n", "u1"), ("text", "<u8" if self.words else "u1", (self.context,))])

    def names(self, rows: np.ndarray) -> np.ndarray:
        """A number for each phrase; those with the same symbols and windows, and only they, have the same."""
        offsets = self.length - self.gram + 1
        return (X.equal_rows(np.ascontiguousarray(rows["text"])) * offsets + rows["lo"]) * offsets + rows["hi"]


class _Slice:
    """Symbols of some whole texts of a chunk, with their triggers."""

    def __init__(self, rule: Rule, first: int, data: np.ndarray, offsets: np.ndarray):
        self.rule, self.first, self.data = rule, first, data
        if rule.words:
            self.starts, self.ends, self.at = X.words(data, offsets, ~SPACE_OR_CONTROL)
            self.symbols = X.word_hashes(data, self.starts, self.ends, rule.key)
            values = self.symbols
        else:
            self.at, self.symbols, values = offsets, data, X.BYTE_VALUE[data]
        self.sums = X.prefix(values)

    def triggers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Position, hash and row (in the slice) of each trigger, and of the windows that are its own (those
        in which it is the first of the smallest grams) the first and last, as offsets in its phrase."""
        n, k, length = len(self.symbols), self.rule.gram, self.rule.length
        none = np.empty(0, np.int64)
        if n < length:
            return none, np.empty(0, np.uint64), none, none, none
        grams, wide = X.span_all(self.sums, k), length - k + 1
        least = _slide(grams, wide, np.minimum)
        row_of = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        row_end = self.at[1:][row_of[: len(least)]]
        least[np.arange(length, n + 1) > row_end] = 0
        pad = np.zeros(wide - 1, np.uint64)
        padded = np.concatenate([pad, least, pad])
        at = np.flatnonzero((grams == _slide(padded, wide, np.maximum)) & (grams > 0))
        hashes = grams[at]
        low, high = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        cells = max(1, (1 << 22) // wide)
        for i in range(0, len(at), cells):  # windows are starts from at - wide + 1 to at
            own = padded[at[i : i + cells, None] + np.arange(wide)] == hashes[i : i + cells, None]
            low[i : i + cells] = own.argmax(axis=1)
            high[i : i + cells] = wide - 1 - own[:, ::-1].argmax(axis=1)
        # windows that hold an equal gram before this one are that one's
        again = np.flatnonzero(hashes[1:] == hashes[:-1]) + 1
        low[again] = np.maximum(low[again], at[again - 1] + wide - at[again])
        mine = low <= high
        return at[mine], hashes[mine], row_of[at[mine]], low[mine], high[mine]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the window at each place, of its symbols."""
        out = np.empty((2, len(at)), np.uint64)
        for i in range(0, len(at), 1 << 14):
            columns = X.as_numbers(self.symbols[at[i : i + (1 << 14), None] + np.arange(self.rule.length)])
            for seed in (0, 1):
                out[seed, i : i + (1 << 14)] = X.chained(columns, self.rule.key ^ seed)
        return out[0], out[1]


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of `width` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def _sorted_chunk(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Ids and texts in an order that depends on the rows alone, as rows are named by their place."""
    table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")]))
    text = table.column("text")
    return X.ids_of(table.column("id")), text


def _slices(rule: Rule, text):
    for first, data, offsets in X.slices(text):
        yield _Slice(rule, first, data, offsets)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _squeezed(rows: np.ndarray) -> bytes:
    """Phrases field by field, texts last, compressed."""
    plain = b"".join(X.pack(rows[name]) for name in rows.dtype.names)
    return len(rows).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unsqueezed(blob, dtype: np.dtype) -> np.ndarray:
    blob = memoryview(blob)
    rows = np.empty(int.from_bytes(blob[:8], "little"), dtype)
    plain = np.frombuffer(pa.decompress(pa.py_buffer(blob[8:]), rows.nbytes, codec="zstd"), np.uint8)
    at = 0
    for name in dtype.names:
        size = rows[name].nbytes
        rows[name] = plain[at : at + size].view(dtype[name].base).reshape(rows[name].shape)
        at += size
    return rows


def _counts(rows: np.ndarray) -> bytes:
    """Fingerprints in order, as compressed differences, and their counts."""
    rows = rows[np.argsort(rows["fp"], kind="stable")]
    steps = np.diff(rows["fp"], prepend=np.uint32(0)).astype("<u4")
    plain = steps.view(np.uint8).reshape(-1, 4).T.tobytes() + rows["n"].tobytes()
    return len(rows).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _counted(blob) -> np.ndarray:
    blob = memoryview(blob)
    rows = np.empty(int.from_bytes(blob[:8], "little"), _COUNTED)
    plain = np.frombuffer(pa.decompress(pa.py_buffer(blob[8:]), 5 * len(rows), codec="zstd"), np.uint8)
    steps = np.ascontiguousarray(plain[: 4 * len(rows)].reshape(4, -1).T).view("<u4").ravel()
    rows["fp"], rows["n"] = np.cumsum(steps, dtype=np.uint32), plain[4 * len(rows) :]
    return rows


def _messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "chunk", "kind", "blob"])


def _group_starts(keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _count_triggers(rule: Rule, buckets: int):
    def send(key, table):
        ids, text = _sorted_chunk(table)
        hashes, docs = [], []
        for part in _slices(rule, text):
            _, h, row, _, _ = part.triggers()
            hashes.append(h)
            docs.append(ids[part.first + row])
        h, d = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((hashes, np.uint64), (docs, np.int64)))
        order = np.argsort(h, kind="stable")
        h, d = h[order], d[order]
        if rule.earlier and len(h):  # documents count, and ids ascend within a hash
            keep = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
            h = h[keep]
        at = _group_starts(h)
        counted = np.empty(len(at), _COUNTED)
        counted["fp"] = h[at].astype(np.uint32)
        counted["n"] = np.minimum(np.diff(np.r_[at, len(h)]), 255)
        chunk = key[0].as_py()
        return _messages([(b, chunk, 0, _counts(x)) for b, x in X.by_key(_bucket(h[at], buckets), counted)])

    return send


def _repeated_triggers():
    def answer(key, table):
        chunks = table.column("chunk").to_pylist()
        sent = [_counted(b.as_buffer()) for b in table.column("blob")]
        every = np.concatenate(sent)
        order = np.argsort(every["fp"], kind="stable")
        fps = every["fp"][order]
        at = _group_starts(fps)
        total = np.add.reduceat(every["n"][order].astype(np.int64), at)
        repeated, total = fps[at][total > 1], total[total > 1]
        bucket, out = key[0].as_py(), []
        for chunk, mine in zip(chunks, sent):
            place = np.searchsorted(repeated, mine["fp"])
            place[place == len(repeated)] = 0
            found = (repeated[place] == mine["fp"]) if len(repeated) else np.zeros(len(mine), bool)
            if found.any():
                reply = np.empty(int(found.sum()), _COUNTED)
                reply["fp"] = mine["fp"][found]
                reply["n"] = total[place[found]] > HOT_TRIGGER
                out.append((bucket, chunk, 0, _counts(reply)))
        return _messages(out)

    return answer


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans sorted by row and start, overlapping and touching ones joined."""
    if not len(row):
        return np.empty(0, _SPAN)
    order = np.lexsort((start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    reach = np.maximum.accumulate(end + (row << 32)) - (row << 32)
    new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(new)
    out = np.empty(len(at), _SPAN)
    out["row"], out["start"] = row[at], start[at]
    out["end"] = np.maximum.reduceat(end, at)
    return out


def _settle(rule: Rule, key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal things within a chunk: which rows are repeats already, which rows are sent on, and
    for how many each of these stands. key groups equal things, doc has their documents."""
    order = np.lexsort((doc, key))
    at = _group_starts(key[order])
    group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(order)]))
    size = np.diff(np.r_[at, len(order)])
    done, sent, n = np.zeros(len(key), bool), np.zeros(len(key), bool), np.ones(len(key), np.uint8)
    if rule.earlier:
        first = doc[order][at][group] == doc[order]
        done[order[~first]] = True
        sent[order[first]] = True
    else:
        done[order[(size > 1)[group]]] = True
        sent[order[at]] = True
        n[order[at]] = np.minimum(size, 2)
    return done, sent, n


def _send_phrases(rule: Rule, buckets: int):
    length = rule.length

    def send(key, table, replies):
        ids, text = _sorted_chunk(table)
        chunk = key[0].as_py()
        known = [_counted(b.as_buffer()) for b in replies.column("blob")]
        if not known:
            return _messages([])
        wide = np.concatenate([(np.int64(b) << 32) | r["fp"].astype(np.int64) for b, r in zip(replies.column("bucket").to_pylist(), known)])
        hot = np.concatenate([r["n"] for r in known])
        order = np.argsort(wide)
        wide, hot = wide[order], hot[order]
        phrases, phrase_buckets, windows = [], [], []
        for part in _slices(rule, text):
            at, h, row, low, high = part.triggers()
            bucket = _bucket(h, buckets)
            mine = (bucket << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)
            place = np.searchsorted(wide, mine)
            place[place == len(wide)] = 0
            found = wide[place] == mine
            warm = hot[place].astype(bool)
            base = at + rule.gram - length
            cold = np.flatnonzero(found & ~warm)
            if len(cold):
                made = np.zeros(len(cold), rule.phrase)
                b, r = base[cold], row[cold]
                made["fp"], made["row"], made["pos"] = h[cold].astype(np.uint32), part.first + r, b - part.at[r]
                made["doc"], made["lo"], made["hi"] = ids[part.first + r], low[cold], high[cold]
                where = b[:, None] + np.arange(rule.context)
                outside = (where < (b + low[cold])[:, None]) | (where >= (b + high[cold] + length)[:, None])
                texts = part.symbols[np.clip(where, 0, len(part.symbols) - 1)]
                texts[outside] = 0
                made["text"] = texts
                phrases.append(made)
                phrase_buckets.append(bucket[cold])
            warm = np.flatnonzero(found & warm)
            if len(warm):
                count = high[warm] - low[warm] + 1
                at0 = np.repeat(base[warm] + low[warm], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at0, one = np.unique(at0, return_index=True)
                r = np.repeat(row[warm], count)[one]
                made = np.empty(len(at0), _WINDOW)
                made["hash"], made["more"] = part.windows(at0)
                made["doc"], made["row"], made["pos"], made["n"] = ids[part.first + r], part.first + r, at0 - part.at[r], 1
                windows.append(made)
        out, spans = [], []
        if phrases:
            made, where = np.concatenate(phrases), np.concatenate(phrase_buckets)
            done, sent, n = _settle(rule, rule.names(made), made["doc"])
            made["n"] = n
            m = made[done]
            spans.append(_merged(m["row"], m["pos"] + m["lo"].astype(np.int32), m["pos"] + m["hi"].astype(np.int32) + length))
            out += [(b, chunk, _PHRASES, _squeezed(x)) for b, x in X.by_key(where[sent], made[sent])]
        if windows:
            made = np.concatenate(windows)
            done, sent, made["n"] = _settle(rule, _pairs(made), made["doc"])
            m = made[done]
            spans.append(_merged(m["row"], m["pos"], m["pos"] + length))
            m = made[sent]
            out += [(b, chunk, _WINDOWS, X.pack(x)) for b, x in X.by_key(_bucket(m["hash"], buckets), m)]
        if spans:
            s = np.concatenate(spans)
            s = _merged(s["row"], s["start"], s["end"])
            if len(s):
                out.append((chunk % buckets, chunk, _SPANS, X.pack(s)))
        return _messages(out)

    return send


def _pairs(rows: np.ndarray) -> np.ndarray:
    """A number for each window, by both its hashes."""
    order = np.lexsort((rows["more"], rows["hash"]))
    new = np.r_[False, (rows["hash"][order][1:] != rows["hash"][order][:-1]) | (rows["more"][order][1:] != rows["more"][order][:-1])]
    out = np.empty(len(rows), np.int64)
    out[order] = np.cumsum(new[: len(rows)])
    return out


def _per_class(rule: Rule, at: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per class of equal rows (starting at `at`): the smallest document and how many it has."""
    return np.minimum.reduceat(doc, at), np.add.reduceat(n.astype(np.int64), at)


def _repeats(rule: Rule, least: np.ndarray, total: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    return least < doc if rule.earlier else total > 1


def _answer_phrases(rule: Rule, resolve):
    """resolve(rule, phrases, doc, n) -> one boolean per phrase and window offset."""
    length = rule.length

    def answer(key, table):
        kinds = np.array(table.column("kind").to_pylist())
        chunks = np.array(table.column("chunk").to_pylist())
        blobs = [b.as_buffer() for b in table.column("blob")]
        found: list[tuple[np.ndarray, np.ndarray]] = []  # chunk of each span, spans
        for i in np.flatnonzero(kinds == _SPANS):
            s = np.frombuffer(blobs[i], _SPAN)
            found.append((np.full(len(s), chunks[i]), s))
        for kind, dtype, settle in ((_WINDOWS, _WINDOW, _settle_windows), (_PHRASES, rule.phrase, _settle_phrases)):
            own = np.flatnonzero(kinds == kind)
            if not len(own):
                continue
            parts = [_unsqueezed(blobs[i], dtype) if kind == _PHRASES else np.frombuffer(blobs[i], dtype) for i in own]
            rows, origin = np.concatenate(parts), np.repeat(chunks[own], [len(p) for p in parts])
            which, start, end = settle(rule, rows, resolve)
            if len(which):
                s = np.empty(len(which), _SPAN)
                s["row"], s["start"], s["end"] = rows["row"][which], start, end
                found.append((origin[which], s))
        if not found:
            return _messages([])
        origin, s = (np.concatenate(x) for x in zip(*found))
        return _messages([(key[0].as_py(), c, _SPANS, X.pack(_merged(m["row"], m["start"], m["end"]))) for c, m in X.by_key(origin, s)])

    def _settle_windows(rule, rows, _):
        names = _pairs(rows)
        order = np.argsort(names, kind="stable")
        at = _group_starts(names[order])
        least, total = _per_class(rule, at, rows["doc"][order], rows["n"][order])
        group = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(order)]))
        hit = order[_repeats(rule, least[group], total[group], rows["doc"][order], rows["n"][order])]
        return hit, rows["pos"][hit], rows["pos"][hit] + length

    def _settle_phrases(rule, rows, resolve):
        """Runs of whole triggers, a bounded number of phrases at a time."""
        order = np.argsort(rows["fp"], kind="stable")
        cuts = np.r_[_group_starts(rows["fp"][order]), len(order)]
        found, at = [], 0
        while at < len(cuts) - 1:
            to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + max(1, SYMBOLS_AT_ONCE // rule.context), side="right")) - 1)
            own = order[cuts[at] : cuts[to]]
            which, start, end = _settle_run(rule, rows[own], resolve)
            found.append((own[which], start, end))
            at = to
        return tuple(np.concatenate(x) for x in zip(*found))

    def _settle_run(rule, rows, resolve):
        """Phrases that are equal as a whole first; only where a trigger stands in different
        phrases are their windows looked at one by one. rows come by trigger."""
        whole = rule.names(rows)
        order = np.lexsort((whole, rows["fp"]))
        at = np.flatnonzero(np.r_[True, (whole[order][1:] != whole[order][:-1]) | (rows["fp"][order][1:] != rows["fp"][order][:-1])])
        group = np.empty(len(rows), np.int64)
        group[order] = np.repeat(np.arange(len(at)), np.diff(np.r_[at, len(order)]))
        least, total = _per_class(rule, at, rows["doc"][order], rows["n"][order])
        full = _repeats(rule, least[group], total[group], rows["doc"], rows["n"])
        fps = rows["fp"][order][at]
        first = _group_starts(fps)
        several = np.repeat(np.diff(np.r_[first, len(fps)]) > 1, np.diff(np.r_[first, len(fps)]))
        which = [np.flatnonzero(full)]
        start = [(rows["pos"] + rows["lo"].astype(np.int32))[which[0]]]
        end = [(rows["pos"] + rows["hi"].astype(np.int32))[which[0]] + length]
        if several.any():
            some = np.flatnonzero(several)
            one = rows[order[at[some]]].copy()
            place = np.full(len(at), -1)
            place[some] = np.arange(len(some))
            owners = np.flatnonzero(~full & (place[group] >= 0))
            lows, tot = resolve(rule, one, least[some], total[some])
            p = place[group[owners]]
            hit = _repeats(rule, lows[p], tot[p], rows["doc"][owners][:, None], None)
            w, offset = np.nonzero(hit)
            which.append(owners[w])
            start.append(rows["pos"][owners[w]] + offset)
            end.append(rows["pos"][owners[w]] + offset + length)
        return np.concatenate(which), np.concatenate(start), np.concatenate(end)

    return answer


def _cut(rule: Rule):
    def cut(key, table, replies):
        ids, text = _sorted_chunk(table)
        spans = X.rows_of(replies, "blob", _SPAN)
        spans = _merged(spans["row"], spans["start"], spans["end"])
        out = {k: [] for k in ("units", "removed", "spans", "kept")}
        for part in _slices(rule, text):
            rows = len(part.at) - 1
            lo, hi = np.searchsorted(spans["row"], [part.first, part.first + rows])
            mine = spans[lo:hi]
            edge = np.zeros(len(part.symbols) + 1, np.int32)
            base = part.at[mine["row"] - part.first]
            np.add.at(edge, base + mine["start"], 1)
            np.add.at(edge, base + mine["end"], -1)
            gone = np.cumsum(edge[:-1]) > 0
            cuts = np.searchsorted(mine["row"], np.arange(part.first, part.first + rows + 1))
            lost = np.r_[0, np.cumsum(gone)]
            raw = part.data.tobytes()
            for r in range(rows):
                a, b = int(part.at[r]), int(part.at[r + 1])
                own = mine[cuts[r] : cuts[r + 1]]
                out["units"].append(b - a)
                out["removed"].append(int(lost[b] - lost[a]))
                out["spans"].append([{"start": int(s), "end": int(e)} for s, e in zip(own["start"], own["end"])])
                if rule.words:
                    left = np.flatnonzero(~gone[a:b]) + a
                    out["kept"].append(b" ".join([raw[s:e] for s, e in zip(part.starts[left].tolist(), part.ends[left].tolist())]))
                elif len(own):
                    out["kept"].append(part.data[a:b][~gone[a:b]].tobytes())
                else:
                    out["kept"].append(raw[a:b])
        return pa.table([
            X.ids_array(ids), pa.array(out["units"], pa.int64()), pa.array(out["removed"], pa.int64()),
            pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out["kept"], pa.binary()),
        ], names=["id", "units", "removed", "spans", "kept"])

    return cut


def remove_repeats(docs: DataFrame, rule: Rule, resolve, id_col: str, text_col: str, chunks: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """id, units, removed, spans (of symbols, end exclusive) and kept (binary) of each row of docs.

    chunks: shares that documents are dealt into; by default as many as there are `chunk_bytes` of text,
    and at least one a core.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if chunks is None:
        total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        chunks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // chunk_bytes))
    buckets = -(-chunks // CHUNKS_A_BUCKET)
    by = lambda df, key: df.repartitionById(buckets if key == "bucket" else chunks, key)
    dealt = by(source.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int")), "chunk")
    counted = dealt.groupBy("chunk").applyInArrow(_count_triggers(rule, buckets), _MESSAGE)
    repeated = by(counted, "bucket").groupBy("bucket").applyInArrow(_repeated_triggers(), _MESSAGE)
    phrases = dealt.groupBy("chunk").cogroup(by(repeated, "chunk").groupBy("chunk")).applyInArrow(_send_phrases(rule, buckets), _MESSAGE)
    spans = by(phrases, "bucket").groupBy("bucket").applyInArrow(_answer_phrases(rule, resolve), _MESSAGE)
    return dealt.groupBy("chunk").cogroup(by(spans, "chunk").groupBy("chunk")).applyInArrow(_cut(rule), "id long, units long, removed long, spans array<struct<start: long, end: long>>, kept binary")
