"""Secret scans: base patterns, and a linear-chain conditional random field over tokens.

The field tags each token as secret begin (B), inside (I) or outside (O). Its observations are the
shape of a token and of its neighbours, the token as a word (of a list of words that go with secrets,
or with what looks like one) or its provider's prefix, the nearest words before and after, the place it
has (value of an assignment to such a word, inside the quotes of one, beside one, user part of an
address), and features of the file: how dense such words, assignments and quotes are, and the share of
indented lines. Its weights maximise the conditional likelihood of a bounded training set: about
`TRAINING_TEXTS` short texts written by rule in this module (seeded; no corpus row is read). Decoding
is by Viterbi. A token is outside in every best labelling if no run of tokens that holds it could gain by
other labels, whatever they were; only what is left, short runs, is decoded, exactly.

Base spans are whole matches of the patterns and always stay; spans of the field are added unless base
spans cover them wholly, and so may overlap one that is a part of a longer secret. Offsets are code
points, ends exclusive. One pass, no shuffle, linear in the text and its spans; the model is a few
thousand numbers.

Defined results: a null text counts as empty (its redacted text is null); texts without tokens have no
spans; every row is scanned by itself, so repeated rows have the same spans; rows keep all their columns.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from . import _text as X

#: The base patterns; fixed values. Letters of the key words match in either case, ASCII only.
ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

SHAPES = ("edge", "word", "key", "assign", "quote", "mark", "number", "hex24", "hex12", "access", "mixed20", "mixed8", "path", "letters24", "capitals", "prefixed", "uuid", "slashes", "code")
_SHAPE = {s: i for i, s in enumerate(SHAPES)}
O, B, I = range(3)
TRAINING_TEXTS = 1500
#: Words that stand beside secrets, and beside what looks like one but is none; fixed values.
CUES = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "bearer", "authorization", "auth", "private", "access", "signature", "login", "pin", "key")
OTHERS = ("is", "was", "user", "username", "commit", "sha", "sha1", "sha256", "md5", "hash", "checksum", "uuid", "guid", "id", "version", "build", "order", "serial", "isbn", "model", "revision", "release", "ticket", "invoice", "https", "http", "reset", "policy", "count", "length", "limit", "expired", "invalid", "name")
_WORDS = {w: i + 1 for i, w in enumerate(CUES + OTHERS)}
#: What the keys of some providers begin with; fixed values.
PREFIXES = ("ghp_", "gho_", "ghs_", "sk-", "sk_", "pk_", "xoxb-", "xoxp-", "glpat-", "npm_", "AIza", "eyJ", "hf_", "SG.", "shpat_")
_CUE_IN = r"passw|passphrase|passcode|pwd|secret|token|api[_-]?key|credential|bearer|authorization|_auth|_key\.*$|^key\.*$|^pin\.*$|login"
_PREFIXED = re.compile(rb"(?:" + b"|".join(re.escape(p.encode()) for p in PREFIXES) + rb"|[a-z]{2,6}[_-](?:[a-z]{2,4}[0-9]?[_-])?)(?=[A-Za-z0-9_.-]{12,}$)(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_.-]*[A-Za-z0-9]{12,}[A-Za-z0-9_.-]*$")
#: Places: none, the value of a cue, in its quotes, after "is" or "was", beside a cue, user part.
NOWHERE, VALUE, IN_QUOTES, SAID, BESIDE, USER_PART = range(6)
_REACH = 8
FILE_FEATURES = 4

_CLASS = np.zeros(256, np.uint8)  # 0 space, 1 token characters, 2 = and :, 3 quotes, 4 other marks
_CLASS[0x21:0x80] = 4
_CLASS[X.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))] = 1
for _c in b"+/_.-":
    _CLASS[_c] = 1
for _c in b"=:":
    _CLASS[_c] = 2
for _c in b"\"'`":
    _CLASS[_c] = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_HEX = X.byte_class((0x30, 0x39), (0x61, 0x66))


def _sums(members: np.ndarray, data: np.ndarray) -> np.ndarray:
    """How many bytes of a class lie before each place."""
    out = np.zeros(len(data) + 1, np.int32)
    np.cumsum(members[data], out=out[1:])
    return out


_DIGIT, _UPPER, _LOW, _HIGH = (X.byte_class(c) for c in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
_ANY_HEX = X.byte_class((0x30, 0x39), (0x41, 0x46), (0x61, 0x66))


def kinds_of(tokens: pa.Array) -> np.ndarray:
    """Shape and word of each token (binary), two columns. A word is the number of one of the listed
    words, or of a provider's prefix, or of the cue in a name; 0 for others."""
    n_all = len(tokens)
    if not n_all:
        return np.empty((0, 2), np.int64)
    data, offsets = X.text_buffer(tokens)
    starts, ends = offsets[:-1], offsets[1:].copy()
    while True:  # full stops after a token are none of its own
        stop = (ends - starts > 1) & (data[ends - 1] == 0x2E)
        if not stop.any():
            break
        ends[stop] -= 1
    low = starts.copy()
    while True:
        stop = (low < ends - 1) & (data[low] == 0x2E)
        if not stop.any():
            break
        low[stop] += 1
    n = ends - starts
    count = lambda members, first=starts: (lambda c: c[ends] - c[first])(_sums(members, data))
    digits, upper, lower, high = (count(m) for m in (_DIGIT, _UPPER, _LOW, _HIGH))
    letters, dots, dashes = lower + upper, count(X.byte_class(0x2E)), count(X.byte_class(0x2D))
    inner_dots, marks = count(X.byte_class(0x2E), low), count(X.byte_class(0x2F, 0x5F, 0x2E))
    byte = lambda at: data[np.minimum(starts + at, len(data) - 1)]
    kind = _CLASS[byte(0)]
    plain = high == 0
    cue = (n <= 32) & plain & pc.match_substring_regex(tokens, _CUE_IN, ignore_case=True).to_numpy(zero_copy_only=False)
    prefixed = np.zeros(n_all, bool)
    for i in np.flatnonzero((n >= 15) & plain & (digits > 0) & (letters > 0) & (kind == 1)).tolist():
        prefixed[i] = _PREFIXED.match(data[starts[i] : ends[i]].tobytes()) is not None
    uuid = (n == 36) & (dashes == 4) & (count(_ANY_HEX) == 32)
    for at in (8, 13, 18, 23):
        uuid &= byte(at) == 0x2D
    akia = (n >= 16) & (digits + upper == n)
    for at, c in enumerate(b"AKIA"):
        akia &= byte(at) == c
    hexes = plain & (digits >= 2) & (count(_IS_HEX) == n)
    mixed = plain & (inner_dots == 0)
    s = _SHAPE
    shape = np.select(
        [kind == 2, kind == 3, kind == 4, (n >= 2) & (byte(0) == 0x2F) & (byte(1) == 0x2F), uuid, prefixed, akia, (digits == n) | ((digits > 0) & (digits + dots + dashes == n)), hexes & (n >= 24), hexes & (n >= 12), cue,
         mixed & (n >= 20) & (digits >= 3) & (letters >= 3), mixed & (n >= 8) & (digits >= 2) & (letters >= 2), marks > 0, plain & (n >= 24) & (upper >= 3) & (lower >= 3), (upper == n) & (n > 1), plain & (n >= 6) & (digits > 0) & (letters > 0)],
        [s[x] for x in ("assign", "quote", "mark", "slashes", "uuid", "prefixed", "access", "number", "hex24", "hex12", "key", "mixed20", "mixed8", "path", "letters24", "capitals", "code")], s["word"],
    )
    text = tokens.cast(pa.large_string() if pa.types.is_large_binary(tokens.type) else pa.string())
    name = pc.ascii_trim(pc.ascii_lower(text), "._-/+")
    word = pc.fill_null(pc.index_in(name, value_set=pa.array(list(_WORDS), name.type)), -1).to_numpy().astype(np.int64) + 1
    for i in np.flatnonzero(cue & (word == 0)).tolist():
        of = name[i].as_py()
        word[i] = next((_WORDS[w] for w in CUES[:-1] if w in of), _WORDS["key"])
    for i, p in reversed(list(enumerate(PREFIXES))):
        begins = pc.starts_with(text, p).to_numpy(zero_copy_only=False)
        word[begins & ((word == 0) | (word > len(_WORDS)))] = 1 + len(_WORDS) + i
    return np.stack([shape, word], axis=1)


_N_WORDS = 1 + len(_WORDS) + len(PREFIXES)
_N_CUES = len(CUES)


def _training(seed: int = 11) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Texts and the byte spans of their secrets, by rule."""
    pick = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda letters, a, b: "".join(pick.choices(letters, k=pick.randint(a, b)))
    syllables = [c + v for c in "bdfgklmnprstvz" for v in "aeiou"]
    word = lambda: "".join(pick.choices(syllables, k=pick.randint(1, 4))) + pick.choice(["", "n", "s", "r"])

    def prose(n):
        out = []
        for _ in range(n):
            w = pick.random()
            out.append(word() if w < 0.9 else word().capitalize() if w < 0.94 else some(digits, 1, 5) if w < 0.97 else pick.choice(["the", "is", "key", "user", "token", "login", "id", "was", "secret", "access"]))
            if pick.random() < 0.1:
                out[-1] += pick.choice([".", ",", ":", ";", "!", "?"])
        return " ".join(out)

    def mixed(a, b):  # letters of both cases and digits
        return pick.choice(upper) + some(lower + upper + digits, a, b) + pick.choice(digits) + pick.choice(lower) + pick.choice(digits)

    def value():
        return pick.choice([lambda: mixed(6, 30), lambda: some(lower + digits, 6, 12) + pick.choice(digits) + some(lower, 1, 4), lambda: some("abcdef" + digits, 16, 64), lambda: word() + some(digits, 2, 4), lambda: mixed(10, 20) + "=" * pick.randint(1, 2), lambda: mixed(4, 9) + pick.choice("/+") + mixed(8, 20), lambda: some(lower + upper, 26, 40), provider])()

    def provider():
        return pick.choice(PREFIXES[:-2] + (some(lower, 2, 5) + "_",)) + mixed(14, 36)

    def uuid():
        return "-".join(some("abcdef" + digits, n, n) for n in (8, 4, 4, 4, 12))

    cue = lambda: pick.choice([pick.choice(CUES[:11]), pick.choice(["db_pwd", "my_password", "SECRET_KEY", "auth_token", "client_secret", "ACCESS_TOKEN", "DB_PASSWORD", "passphrase"])])
    assign = lambda: pick.choice([" = ", "=", ": ", ":", " := "])

    def positive():
        k, v = pick.randrange(10), value()
        if k < 4:
            q = pick.choice(["", "", '"', "'"])
            key = pick.choice(["{}", '"{}"']).format(cue())
            return key + assign() + q, v, q
        if k == 4:
            return f"{pick.choice(['the', 'my', 'your'])} {pick.choice(['password', 'passcode', 'pwd', 'token', 'login', 'secret'])} {pick.choice(['is', 'was'])} ", mixed(4, 16), ""
        if k == 5:
            return f"{word()}{pick.choice(['://', 'ql://', 's://'])}{word()}:", pick.choice([mixed(3, 12), word() + some(digits, 1, 4), word(), some(lower, 8, 14)]), f"@{word()}.{word()}{pick.choice(['', '/' + word(), ':' + some(digits, 4, 4)])}"
        if k == 6:
            joined = pick.choice(["-", " "])
            q = pick.choice(['"', "'"]) if joined == " " else pick.choice(["", '"'])
            return f"{pick.choice(['passphrase', 'my_passphrase', 'password', 'PASSPHRASE'])}{assign()}{q}", joined.join(word() for _ in range(pick.randint(3, 5))), q
        if k == 7:
            return pick.choice(["Authorization: Bearer ", "Bearer ", "bearer ", "Authorization: Basic "]), mixed(16, 40), ""
        if k == 8:
            return pick.choice(["credentials: ", "login: ", "credential ", "api key ", "access key "]), pick.choice([mixed(8, 20), provider()]), ""
        return "", provider(), ""

    def negative():
        return pick.choice([
            lambda: f"{pick.choice(['commit', 'revision', 'build', 'sha', 'release'])}{pick.choice([' ', ': '])}{some('abcdef' + digits, 7, 14)}", uuid, lambda: f"{pick.choice(['id', 'uuid', 'guid', 'order', 'token id', 'key'])}{pick.choice([' ', ': ', '='])}{uuid()}",
            lambda: f"{pick.choice(['order', 'serial', 'invoice', 'ticket', 'isbn', 'model'])} {some(upper, 2, 3)}-{some(digits, 4, 9)}", lambda: f"version {some(digits, 1, 2)}.{some(digits, 1, 2)}", lambda: f"https://{word()}.{word()}/{word()}/{some(lower + digits, 4, 12)}",
            lambda: f"http://{word()}:{some(digits, 4, 4)}/{word()}", lambda: f"{word()}@{word()}.com", lambda: f"the {pick.choice(['password', 'token', 'secret', 'key', 'login'])} {pick.choice(['reset', 'policy', 'expired', 'of', 'and', 'was', 'is'])} {word()}", lambda: f"{pick.choice(['token', 'key', 'secret', 'pin'])}: {word()} {word()}",
            lambda: f"{word()}: {word()}", lambda: f"{word()} = {some(digits, 1, 6)}", lambda: f"{cue()} {pick.choice(['count', 'length', 'limit'])} = {some(digits, 1, 5)}", lambda: f"{word()}{some(digits, 1, 4)} {some(upper, 2, 5)}{some(digits, 1, 4)}", lambda: f"/{word()}/{word()}_{some(digits, 1, 3)}.{word()}", lambda: f'{word()}="{word()} {word()}"',
            lambda: some(lower, 20, 30), lambda: f"{word()}-{word()}-{word()}", lambda: f"{pick.choice(['md5', 'sha256', 'checksum', 'hash'])}{pick.choice([' ', ': ', '='])}{some('abcdef' + digits, 12, 23)}", lambda: f"{word()}_{word()}_{some(digits, 1, 6)}",
        ])()

    out = []
    for _ in range(TRAINING_TEXTS):
        text, spans = prose(pick.randint(0, 7)), []
        for _ in range(pick.randint(1, 3)):
            text += pick.choice([" ", " ", "\n", "\n    ", ". "]) if text else ""
            if pick.random() < 0.5:
                before, secret, after = positive()
                start = len(text) + len(before)
                text += before + secret + after
                spans.append((start, start + len(secret)))
            else:
                text += negative()
            text += pick.choice([" ", "\n", ", "]) + prose(pick.randint(0, 6))
        out.append((text.encode(), spans))
    return out


#: Of each token: shape, before, after, word, word before, word after, place, shape at its place, length.
_SIZES = (len(SHAPES),) * 3 + (_N_WORDS,) * 3 + (6, 6 * len(SHAPES), 6)


def _shifted(x: np.ndarray, by: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of each token what x has `by` tokens later; 0 beyond the text. first, last: each token's text."""
    at = np.arange(len(x)) + by
    inside = (at >= first) & (at < last)
    return np.where(inside, x[np.clip(at, 0, max(len(x) - 1, 0))], 0)


def observations(shapes: np.ndarray, words: np.ndarray, sizes: np.ndarray, at: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A row of feature numbers per token. at: first token of each text and one more; marks: the first
    byte of each token."""
    n = len(shapes)
    count = np.diff(at)
    first, last = np.repeat(at[:-1], count), np.repeat(at[1:], count)
    s = _SHAPE
    passing = (shapes == s["assign"]) | (shapes == s["quote"]) | (shapes == s["mark"])

    def nearest(step):
        out, done = np.zeros(n, np.int64), np.zeros(n, bool)
        for k in (1, 2, 3):
            w, p = _shifted(words, k * step, first, last), _shifted(passing.astype(np.int8), k * step, first, last)
            out = np.where(done, out, w)
            done |= p == 0
        return out

    place = np.zeros(n, np.int64)
    cues = np.flatnonzero((shapes == s["key"]) | ((words > 0) & (words <= _N_CUES)))
    said = (_WORDS["is"], _WORDS["was"])
    for i in cues.tolist():
        end, j = int(last[i]), i + 1
        if j < end and shapes[j] == s["quote"]:
            j += 1
        if j >= end:
            continue
        if shapes[j] == s["assign"]:
            j += 1
            if j < end and shapes[j] == s["quote"]:
                close = marks[j]
                j += 1
                for t in range(j, min(end, j + _REACH)):
                    if shapes[t] == s["quote"] and marks[t] == close:
                        break
                    place[t] = IN_QUOTES
            elif j < end:
                place[j] = VALUE
        elif j == i + 1:
            if words[j] in said and j + 1 < end:
                place[j + 1] = SAID
            elif place[j] == NOWHERE:
                place[j] = BESIDE
    for i in np.flatnonzero(shapes == s["slashes"]).tolist():
        if i + 3 < last[i] and i > first[i] and shapes[i - 1] == s["assign"] and shapes[i + 1] == s["assign"]:
            t = i + 2
            while t < min(int(last[i]), i + 2 + _REACH) and shapes[t] not in (s["mark"], s["assign"], s["quote"]):
                t += 1
            if t < last[i] and marks[t] == 0x40:
                place[i + 2 : t] = USER_PART
    length = np.minimum(np.log2(np.maximum(sizes, 1)).astype(np.int64), 5)
    columns = [shapes, _shifted(shapes, -1, first, last), _shifted(shapes, 1, first, last), words, nearest(-1), nearest(1), place, place * len(SHAPES) + shapes, length]
    return np.stack(columns, axis=1) + np.r_[0, np.cumsum(_SIZES)[:-1]]


class Field:
    """Weights of a trained field: three label scores per observation, and the moves between labels."""

    def __init__(self, own: np.ndarray, file: np.ndarray, moves: np.ndarray):
        self.own, self.file, self.moves = own, file, moves
        self._bounds()

    def _bounds(self) -> None:
        """What the moves of a run of tokens in secrets can gain at most over those of outside ones: for
        each step in the run, and for entering and leaving it."""
        m = self.moves
        self.step = float(m[1:, 1:].max() - m[O, O])
        self.ends = max(float(m[O, B] - m[O, O]), 0.0) + max(float(m[1:, O].max() - m[O, O]), 0.0)

    def surely_outside(self, emissions: np.ndarray) -> np.ndarray:
        """Tokens that no run can hold whose labels gain as much as the outside would: of all runs that
        hold a token, the best one's bound is a difference of extremes of prefix sums."""
        gain = np.maximum(emissions[:, B], emissions[:, I]) - emissions[:, O] + self.step
        sums = np.r_[0.0, np.cumsum(gain)]
        best = np.maximum.accumulate(sums[:0:-1])[::-1] - np.minimum.accumulate(sums[:-1])
        return best + self.ends - self.step < -1e-6

    def _with(self, own: np.ndarray, file: np.ndarray) -> "Field":
        self.own, self.file = own, file
        return self

    def emissions(self, observed: np.ndarray, file: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Label scores of all tokens; file has a row per text."""
        out = (file @ self.file)[row]
        for column in observed.T:
            out += self.own[column]
        return out

    def viterbi(self, emissions: np.ndarray, starts: bool, ends: bool) -> list[int]:
        """The best labels of a run; its neighbours, if any, are outside."""
        moves = self.moves
        best = emissions[0] + moves[O] if not starts else emissions[0] + np.array([0.0, 0.0, -np.inf])
        back = []
        for e in emissions[1:]:
            through = best[:, None] + moves
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + e
        if not ends:
            best = best + moves[:, O]
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


@lru_cache(maxsize=1)
def trained_field(steps: int = 90, rate: float = 0.4, ridge: float = 3e-4) -> Field:
    """Maximum conditional likelihood by accelerated gradient steps over the padded training set."""
    data = _training()
    raw, offsets = X.text_buffer(pa.array([t for t, _ in data], pa.binary()))
    starts, ends, at, observed, file, _ = Scanner(None).observe(raw, offsets)
    n, longest = len(data), int(np.diff(at).max())
    row = np.repeat(np.arange(n), np.diff(at))
    column = np.arange(len(row)) - at[row]
    labels = np.zeros(len(row), np.int64)
    for r, (_, spans) in enumerate(data):
        for a, b in spans:
            inside = np.flatnonzero((starts[at[r] : at[r + 1]] < offsets[r] + b) & (ends[at[r] : at[r + 1]] > offsets[r] + a)) + at[r]
            labels[inside] = I
            labels[inside[:1]] = B
    one, k = np.eye(3), sum(_SIZES)
    mask = np.zeros((n, longest), bool)
    mask[row, column] = True
    both = mask[:, 1:]
    padded = np.zeros((n, longest), np.int64)
    padded[row, column] = labels
    seen = (one[padded[:, :-1]][:, :, :, None] * one[padded[:, 1:]][:, :, None, :] * both[:, :, None, None]).sum(axis=(0, 1))

    def parts(w):
        m = w[-9:].reshape(3, 3).copy()
        m[O, I] = -1e4
        return w[: 3 * k].reshape(k, 3), w[3 * k : -9].reshape(-1, 3), m

    def soft(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    def gradient(w):
        own, f, m = parts(w)
        e = np.zeros((n, longest, 3))
        e[row, column] = Field.emissions(Field.__new__(Field)._with(own, f), observed, file, row)
        alpha, beta = np.zeros((longest, n, 3)), np.zeros((longest, n, 3))
        alpha[0] = e[:, 0] + np.array([0, 0, -1e4])
        for t in range(1, longest):
            alpha[t] = np.where(mask[:, t, None], soft(alpha[t - 1][:, :, None] + m, 1) + e[:, t], alpha[t - 1])
        for t in range(longest - 2, -1, -1):
            beta[t] = np.where(mask[:, t + 1, None], soft(m + (e[:, t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        total = soft(alpha[-1], 1)
        d = one[labels] - np.exp((alpha + beta)[column, row] - total[row, None])
        g = np.zeros((k, 3))
        for c in observed.T:
            for label in range(3):
                g[:, label] += np.bincount(c, weights=d[:, label], minlength=k)
        texts = np.zeros((n, 3))
        np.add.at(texts, row, d)
        pair = np.exp(alpha[:-1].transpose(1, 0, 2)[:, :, :, None] + m + (e[:, 1:] + beta[1:].transpose(1, 0, 2))[:, :, None, :] - total[:, None, None, None])
        moves = seen - (pair * both[:, :, None, None]).sum(axis=(0, 1))
        moves[O, I] = 0
        return np.concatenate([x.ravel() for x in (g, file.T @ texts, moves)]) / n * 4 - ridge * w

    w = np.zeros(3 * k + 3 * FILE_FEATURES + 9)
    look, last = w.copy(), w.copy()
    for i in range(steps):
        w = look + rate * gradient(look)
        look = w + i / (i + 3) * (w - last)
        last = w
    return Field(*parts(w))


def _union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that spans, sorted by start, make where they meet."""
    starts, ends = [], []
    for a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _covered(start: int, end: int, union: tuple[list[int], list[int]]) -> bool:
    """Does one of the runs hold all of [start, end)?"""
    i = bisect_right(union[0], start) - 1
    return i >= 0 and end <= union[1][i]


class Scanner:
    def __init__(self, field: Field):
        self.field = field

    def _tokens(self, data: np.ndarray, offsets: np.ndarray):
        kind = _CLASS[data]
        change = np.ones(len(data) + 1, bool)
        change[1:-1] = kind[1:] != kind[:-1]
        change[offsets] = True
        edges = np.flatnonzero(change)
        starts, ends = edges[:-1], edges[1:]
        real = kind[starts] > 0 if len(starts) else np.empty(0, bool)
        starts, ends = starts[real], ends[real]
        return starts, ends, np.searchsorted(starts, offsets)

    def observe(self, data: np.ndarray, offsets: np.ndarray):
        """Tokens (starts, ends, first of each text), their observations, those of the texts, and each
        token's text."""
        starts, ends, at = self._tokens(data, offsets)
        which, tokens = X.distinct(data, starts, ends)
        kinds = kinds_of(tokens)[which]
        shapes, words = kinds[:, 0], kinds[:, 1]
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        n, count = len(at) - 1, np.maximum(np.diff(at), 1)
        lines = np.flatnonzero(data == 0x0A)
        lines = lines[lines + 1 < len(data)]
        of = np.searchsorted(offsets, lines, side="right") - 1
        share = lambda rows, weights=None: np.bincount(rows, weights=weights, minlength=n)
        s = _SHAPE
        indented = share(of, np.isin(data[lines + 1], (0x20, 0x09)).astype(float)) / np.maximum(share(of), 1)
        file = np.stack([
            np.minimum(share(row, shapes == s["key"]) / count * 10, 1), np.minimum(share(row, shapes == s["assign"]) / count * 5, 1), np.minimum(share(row, shapes == s["quote"]) / count * 5, 1), indented,
        ], axis=1)
        return starts, ends, at, observations(shapes, words, ends - starts, at, data[starts]), file, row

    def field_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, start byte, end byte) of the field's spans in a slice."""
        if not len(data):
            return []
        starts, ends, at, observed, file, row = self.observe(data, offsets)
        if not len(starts):
            return []
        e = self.field.emissions(observed, file, row)
        at_open = np.flatnonzero(~self.field.surely_outside(e))
        if not len(at_open):
            return []
        cut = np.flatnonzero((np.diff(at_open) > 1) | (row[at_open[1:]] != row[at_open[:-1]])) + 1
        out, memo = [], {}
        for run in np.split(at_open, cut):
            a, b = int(run[0]), int(run[-1]) + 1
            r = int(row[a])
            edge = (bool(a == at[r]), bool(b == at[r + 1]))
            key = (e[a:b].tobytes(), *edge)
            labels = memo.get(key)
            if labels is None:
                labels = memo[key] = self.field.viterbi(e[a:b], *edge)
            i = 0
            while i < len(labels):
                if labels[i] == B:
                    j = i + 1
                    while j < len(labels) and labels[j] == I:
                        j += 1
                    begin, end = int(starts[a + i]), int(ends[a + j - 1])
                    while end - begin > 1 and data[end - 1] == 0x2E:  # a full stop ends the sentence
                        end -= 1
                    out.append((r, begin, end))
                    i = j
                else:
                    i += 1
        return out

    def base_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, kind, start byte, end byte), by text."""
        raw = data.tobytes()
        low = _LOWER[data].tobytes()
        rows: set[int] = set()
        for stem in (b"passw", b"secret", b"token", b"api"):
            at, places = low.find(stem), []
            while at >= 0:
                places.append(at)
                at = low.find(stem, at + 1)
            rows.update((np.searchsorted(offsets, places, side="right") - 1).tolist())
        out = []
        for r in sorted(rows):
            a = int(offsets[r])
            out += [(r, 0, a + m.start(), a + m.end()) for m in ASSIGN.finditer(raw[a : int(offsets[r + 1])]) if len(m[2]) >= 6]
        rows = set()
        at, places = raw.find(b"AKIA"), []
        while at >= 0:
            places.append(at)
            at = raw.find(b"AKIA", at + 1)
        rows.update((np.searchsorted(offsets, places, side="right") - 1).tolist())
        for r in sorted(rows):
            a = int(offsets[r])
            out += [(r, 1, a + m.start(), a + m.end()) for m in ACCESS.finditer(raw[a : int(offsets[r + 1])])]
        starts, ends, _ = X.words(data, offsets, _IS_HEX)
        long_enough = ends - starts >= 24
        starts, ends = starts[long_enough], ends[long_enough]
        out += [(int(r), 2, int(s), int(t)) for r, s, t in zip(np.searchsorted(offsets, starts, side="right") - 1, starts, ends)]
        return sorted(out, key=lambda s: (s[0], s[2], s[1]))

    def byte_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, kind, start byte, end byte) of all spans, by text and start."""
        base = self.base_spans(data, offsets)
        taken: dict[int, list] = {}
        for r, _, a, b in base:
            taken.setdefault(r, []).append((a, b))
        runs = {r: _union(spans) for r, spans in taken.items()}
        added = [(r, 3, a, b) for r, a, b in self.field_spans(data, offsets) if r not in runs or not _covered(a, b, runs[r])]
        return sorted(base + added, key=lambda s: (s[0], s[2], s[1]))

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per text the (kind, start, end) of all spans by start, in code points."""
        return _in_code_points(self.byte_spans(data, offsets), data, offsets)


def _in_code_points(spans, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(offsets) - 1)]
    at, points = -1, None
    for r, kind, a, b in spans:
        if r != at:
            at, points = r, np.r_[0, np.cumsum((data[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)]
        out[r].append((kind, int(points[a - offsets[r]]), int(points[b - offsets[r]])))
    return out


def _redacted(spans, data: np.ndarray, offsets: np.ndarray, mark: bytes, text: pa.Array) -> pa.Array:
    """The texts with each run of overlapping spans replaced by the mark; null stays null."""
    left, at, longer = [], 0, np.zeros(len(offsets) - 1, np.int64)
    runs: list[list[int]] = []
    for r, _, a, b in spans:
        if runs and runs[-1][0] == r and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([r, a, b])
    raw = data.tobytes()
    for r, a, b in runs:
        left += (raw[at:a], mark)
        at = b
        longer[r] += len(mark) - (b - a)
    left.append(raw[at:])
    ends = offsets + np.r_[0, np.cumsum(longer)]
    made = pa.LargeStringArray.from_buffers(len(longer), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(b"".join(left))).cast(pa.string())
    return pc.if_else(text.is_valid(), made, pa.scalar(None, pa.string())) if text.null_count else made


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def with_secrets(docs: DataFrame, text_col: str = "text", spans_col: str = "secret_spans", redacted_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs with all their columns and their spans: kind (assign, access, hex, crf), start
    and end in code points, by start; and with redacted_col the text with each run of overlapping spans
    replaced by the mark."""
    added = [spans_col] + ([redacted_col] if redacted_col else [])
    taken = {c.lower() for c in docs.columns} & {c.lower() for c in added}
    if taken:
        raise ValueError(f"docs has columns {sorted(taken)}; name others")
    at, names = X.place_of(docs.columns, text_col), docs.columns
    field = trained_field()

    def run(batches):
        scanner = Scanner(field)
        for batch in batches:
            for first, data, offsets in X.slices(batch.column(at)):
                own = batch.slice(first, len(offsets) - 1)
                found = scanner.byte_spans(data, offsets)
                columns = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in row] for row in _in_code_points(found, data, offsets)], _ARROW_SPANS)]
                if redacted_col:
                    columns.append(_redacted(found, data, offsets, mark.encode(), own.column(at)))
                yield pa.RecordBatch.from_arrays([*own.columns, *columns], names=[*names, *added])

    spans_type = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    types = [T.StructField(spans_col, spans_type)] + ([T.StructField(redacted_col, T.StringType())] if redacted_col else [])
    return X.numbered(docs).mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema] + types))
