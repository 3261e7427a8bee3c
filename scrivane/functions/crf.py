"""Linear-chain conditional random field over white-space tokens: features, Viterbi decoding, span checks and name splitting."""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .pii import _cut, _rise

_TOKEN = re.compile(rb"[^\t\n\x0c\r ]+")
SUFFIXES = frozenset(
    "apt ave ave. avenue blvd blvd. boulevard box causeway cir circle court cswy ct ct. dr dr. drive highway hwy lane ln ln. mall p.o."
    " parkway pkwy pl pl. place plaza plz po rd rd. road sq square st st. ste street suite ter ter. terrace trail trl unit way".split()
)
STATES = frozenset("AK AL AR AS AZ CA CO CT DC DE FL FM GA GU HI IA ID IL IN KS KY LA MA MD ME MH MI MN MO MP MS MT NC ND NE NH NJ NM NV NY OH OK OR PA PR PW RI SC SD TN TX UT VA VI VT WA WI WV WY".split())
DIRECTIONS = frozenset("e east n n.e. n.w. ne north northeast northwest nw s s.e. s.w. se south southeast southwest sw w west".split())
TITLES = frozenset("dr dr. jr jr. md miss mr mr. mrs mrs. ms ms. phd prof prof. sr sr.".split())
BOXES = frozenset("box p.o p.o. po pobox".split())
LEADS = frozenset("attention attn bill buyer ship to".split())
AFTER_NAMES = frozenset("dds esq ii iii iv jr md phd sr".split())
NOT_NAMES = frozenset(
    "account address bank branch code conditions courier date discount due email gstin http invoice logo note number order payment ship"
    " shipped site subtotal swift table tax terms thank total www.".split()
)
KINDS = frozenset("ACCOUNT ADDRESS EMAIL NAME PHONE ZIP".split())


def tokenize(text: str) -> list[tuple[str, int, int]]:
    """(word, start, end) with byte offsets, split at ASCII white space."""
    raw = text.encode()
    return [(m.group().decode(), *m.span()) for m in _TOKEN.finditer(raw)]


#: The classes of ASCII characters, as in shape().
_CLASSES = str.maketrans({c: "A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else "-" for c in map(chr, range(128))})


def shape(token: str) -> str:
    """The first ten characters as A, a, 0 or -."""
    if token.isascii():
        return token[:10].translate(_CLASSES)
    return "".join("A" if c.isupper() else "a" if c.islower() else "0" if "0" <= c <= "9" else "-" for c in token[:10])


def _core(word: str) -> str:
    return word.rstrip(",.")


def _digits(text: str) -> bool:
    return all("0" <= c <= "9" for c in text)


def _word_key(token: str) -> str:
    low = token.lower()
    return low if len(low.encode()) <= 20 else "__LONG__"


def _looks(t: str) -> tuple[bool, bool, bool, bool, bool, bool]:
    """Whether a token is all upper case, capitalised, or all digits; whether it has a digit or a letter; whether it has neither."""
    if t.isascii():
        s = t.translate(_CLASSES)
        return not s.strip("A"), s[:1] == "A" and not s[1:].strip("a"), not s.strip("0"), "0" in s, "a" in s or "A" in s, bool(s) and not s.strip("-")
    return (
        all(c.isupper() for c in t), t[:1].isupper() and all(c.islower() for c in t[1:]), _digits(t),
        any("0" <= c <= "9" for c in t), any(c.isalpha() for c in t), not any(c.isalnum() for c in t),
    )


_FLAGS = (
    "upper title digit alpha has_digit has_at has_hyphen has_alpha punct street_suffix state_abbrev direction is_bldg_num title_prefix po_box is_name_word"
).split()
_FLAG_NAMES = tuple((f"w_{k}:0", f"w_{k}:1") for k in _FLAGS)


def own_features(t: str) -> list[str]:
    """The names of the features that a token has wherever it stands."""
    low = t.lower()
    size, tail = len(t.encode()), low.rstrip(",.")
    upper, title, digit, has_digit, has_alpha, punct = _looks(t)
    state, alpha, first = len(t) == 2 and t in STATES, t.isalpha(), t[:1]
    suffix, direction, titled, box = tail in SUFFIXES, tail in DIRECTIONS, tail in TITLES, tail in BOXES
    number = "0" <= first <= "9"
    name = first.isupper() and alpha and 2 <= size <= 20 and not (state or suffix or direction or titled or box)
    flags = (upper, title, digit, alpha, has_digit, "@" in t, "-" in t, has_alpha, punct, suffix, state, direction, number and size <= 5 and not digit, titled, box, name)
    begin = "D" if number else "A" if first.isalpha() else "P" if first in ".,-/()" else "X"
    out = [f"w:{_word_key(t)}", f"w_shape:{shape(t)}", f"w_len:{min(size, 20)}", f"w_starts:{begin}"]
    out += [names[v] for names, v in zip(_FLAG_NAMES, flags, strict=True)]
    for n in (2, 3):
        if size >= n:
            out += [f"w_prefix{n}:{low[:n]}", f"w_suffix{n}:{low[-n:]}"]
    return out


#: Places whose tokens' words and shapes are features.
AROUND = (-2, -1, 1, 2)


def token_features(tokens: list[str], i: int) -> list[str]:
    """The names of the indicator features of token i; training and decoding share them."""
    out = own_features(tokens[i])
    out.append(f"pos_bias:{1 if not i else 2 * (i + 1 == len(tokens))}")
    for k in AROUND:
        j = i + k
        inside = 0 <= j < len(tokens)
        out.append(f"w{k:+}:" + (_word_key(tokens[j]) if inside else "__BOS__" if j < 0 else "__EOS__"))
        if inside:
            out.append(f"w{k:+}_shape:{shape(tokens[j])[:8]}")
    return out


def count_features(tokens: pa.Array, bounds: np.ndarray) -> Counter[str]:
    """How often each name of token_features occurs over some texts, whose tokens begin and end at bounds. Names are made once a distinct token."""
    coded = tokens.dictionary_encode()
    code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    size = np.diff(bounds)
    first, last = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
    at = np.arange(len(code))
    out: Counter[str] = Counter()

    def add(names: list[str], code: np.ndarray) -> None:
        for name, n in zip(names, np.bincount(code, minlength=len(names)).tolist(), strict=True):
            if n:
                out[name] += n

    for word, n in zip(words, np.bincount(code, minlength=len(words)).tolist(), strict=True):
        for name in own_features(word):
            out[name] += n
    add(["pos_bias:0", "pos_bias:1", "pos_bias:2"], np.where(at == first, 1, np.where(at + 1 == last, 2, 0)))
    keys, shapes = [_word_key(w) for w in words], [shape(w)[:8] for w in words]
    for k in AROUND:
        inside = (at + k >= first) & (at + k < last)
        near = code[at[inside] + k]
        add([f"w{k:+}:{x}" for x in keys], near)
        add([f"w{k:+}_shape:{x}" for x in shapes], near)
        if outside := int((~inside).sum()):
            out[f"w{k:+}:" + ("__BOS__" if k < 0 else "__EOS__")] += outside
    return out


@dataclass
class Model:
    """labels: K names; weights: a row of K per feature; transitions: K x K, from the row's label to the column's."""

    labels: list[str]
    weights: dict[str, np.ndarray]
    transitions: np.ndarray

    @classmethod
    def load(cls, text: str) -> Model:
        """From {labels, featureIndex, labelWeights, transitions}; labels without weights weigh 0, spare weights and rows are dropped."""
        raw = json.loads(text)
        labels = raw["labels"]
        k = len(labels)
        rows = raw.get("labelWeights", {})
        weights = {}
        for name, at in raw["featureIndex"].items():
            weights[name] = np.array([rows[x][at] if x in rows and at < len(rows[x]) else 0.0 for x in labels], np.float32)
        trans = np.zeros((k, k), np.float32)
        for i, row in enumerate(raw.get("transitions", [])[:k]):
            trans[i, : len(row[:k])] = row[:k]
        return cls(labels, weights, trans)

    def dump(self) -> str:
        names = sorted(self.weights)
        return json.dumps({"labels": self.labels, "featureIndex": {n: i for i, n in enumerate(names)}, "labelWeights": {x: [float(self.weights[n][j]) for n in names] for j, x in enumerate(self.labels)}, "transitions": self.transitions.tolist()})

    def _sum(self, names: list[str]) -> np.ndarray:
        out = np.zeros(len(self.labels), np.float32)
        for name in names:
            if name in self.weights:
                out += self.weights[name]
        return out

    def emit(self, tokens: pa.Array, bounds: np.ndarray) -> np.ndarray:
        """Summed weights of all tokens of some texts, whose tokens begin and end at bounds.

        Features depend on one token each, so they are made once a distinct token; then they are added up in the order of token_features.
        """
        coded = tokens.dictionary_encode()
        code, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        row = {name: k for k, name in enumerate(self.weights)}
        known = np.zeros((len(row) + 1, len(self.labels)), np.float32)  # the last row is for features without weights
        if row:
            known[:-1] = list(self.weights.values())
        table = lambda names: known[np.fromiter((row.get(n, -1) for n in names), np.int64, len(names))]
        own = np.array([self._sum(own_features(w)) for w in words], np.float32).reshape(len(words), len(self.labels))
        keys, shapes = [_word_key(w) for w in words], [shape(w)[:8] for w in words]
        size = np.diff(bounds)
        first, last = np.repeat(bounds[:-1], size), np.repeat(bounds[1:], size)
        at = np.arange(len(code))
        out = own[code]
        out += table(["pos_bias:0", "pos_bias:1", "pos_bias:2"])[np.where(at == first, 1, np.where(at + 1 == last, 2, 0))]
        weighed = {name.partition(":")[0] for name in self.weights}  # of other kinds of features no name needs to be made
        for k in AROUND:
            inside = (at + k >= first) & (at + k < last)
            near = code[at[inside] + k]
            for kind, said in ((f"w{k:+}", keys), (f"w{k:+}_shape", shapes)):
                if kind in weighed:
                    out[inside] += table([f"{kind}:{x}" for x in said])[near]
            out[~inside] += self._sum([f"w{k:+}:" + ("__BOS__" if k < 0 else "__EOS__")])
        return out

    def emissions(self, tokens: list[str]) -> np.ndarray:
        return self.emit(pa.array(tokens, pa.string()), np.array([0, len(tokens)]))


def viterbi_all(emissions: np.ndarray, bounds: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best label path of each of some sequences, end to end; the lower label wins ties. All take a step together, the longest
    first in the arrays, so that those which go on are at the front."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, begin = size[order], bounds[:-1][order]
    path = np.zeros(len(emissions), np.int64)
    live = int((size > 0).sum())
    if not live:
        return path
    back = np.zeros(emissions.shape, np.int16)
    score, final = emissions[begin[:live]], np.empty((live, emissions.shape[1]), emissions.dtype)
    going = [int(np.searchsorted(-size, -t, "left")) for t in range(int(size[0]))]
    for t in range(1, int(size[0])):
        n = going[t]
        final[n:live] = score[n:]
        at = begin[:n] + t
        ways = score[:n, :, None] + transitions[None] + emissions[at][:, None, :]
        back[at], score, live = ways.argmax(1), ways.max(1), n
    final[:live] = score
    path[(begin + size - 1)[: len(final)]] = final.argmax(1)
    for t in range(int(size[0]) - 1, 0, -1):
        at = begin[: going[t]] + t
        path[at - 1] = back[at, path[at]]
    return path


def viterbi(emissions: np.ndarray, transitions: np.ndarray) -> list[int]:
    return viterbi_all(emissions, np.array([0, len(emissions)]), transitions).tolist()


def has_address_signal(text: str) -> bool:
    low = text.lower()
    words = low.split()
    if len(words) > 20:
        return False
    cores = [_core(w) for w in words]
    if any(c in SUFFIXES or c in DIRECTIONS for c in cores) or any(x in low for x in ("p.o.", "po box", "pobox")):
        return True
    if any(w in STATES for w in text.split()):
        return True
    return len(words) >= 2 and any(2 <= len(c.encode()) <= 5 and "0" <= c[0] <= "9" and any(x.isalpha() for x in c) for c in cores)


def has_name_signal(text: str) -> bool:
    words = text.split()
    if not 1 <= len(words) <= 5 or any(_core(w.lower()) in NOT_NAMES for w in words):
        return False
    heavy = sum(0 < (n := sum("0" <= c <= "9" for c in w)) and 2 * n > len(w.encode()) for w in words)
    if heavy >= len(words) // 2 + 1:
        return False
    return any(w[0].isupper() and 2 <= len(w.encode()) <= 20 and 2 * sum(c.isalpha() for c in w) >= len(w) for w in words)


def _walk_back(words: list[str], end: int) -> tuple[int, int]:
    """The capitalised words before `end`: begin and end of the name; a suffix at the very end is skipped."""
    begin, stop = end, end
    for j in range(end - 1, -1, -1):
        core = _core(words[j])
        low = core.lower()
        if not (core.isascii() and core.isalpha()) or low in LEADS:
            break
        if j == end - 1 and low in AFTER_NAMES:
            stop = j
            continue
        if not core[0].isupper():
            break
        begin = j
    return begin, stop


def name_prefix(text: str) -> int | None:
    """Where, in bytes, the street number begins that follows a name of one to three words."""
    words = text.split()
    at = next((i for i, w in enumerate(words) if (c := _core(w)) and "0" <= c[0] <= "9" and len(c.encode()) <= 5), None)
    if len(words) < 3 or not at:
        return None
    begin, _ = _walk_back(words, at)
    if not 1 <= at - begin <= 3:
        return None
    # The first place before which all words of the name are complete.
    seen = [m.end() for m in re.finditer(r"\S+", text)]
    place = len(text[: seen[at - 1]].encode())
    return place if place < len(text.encode()) else None


def leading_name(text: str) -> str | None:
    """A name of one to three capitalised words at the end of a text."""
    words = text.split()
    begin, stop = _walk_back(words, len(words))
    return " ".join(words[begin:stop]) if 1 <= stop - begin <= 3 else None


def _valid(kind: str, text: str) -> bool:
    if kind == "EMAIL":
        return 0 < text.find("@") < len(text.encode()) - 3
    if kind == "ZIP":
        return len(text) == 5 and _digits(text)
    if kind == "ACCOUNT":
        return len(text) >= 6 and _digits(text)
    if kind == "ADDRESS":
        return has_address_signal(text)
    return kind != "NAME" or any(c.isalpha() for c in text) and has_name_signal(text)


def spans(labels: list[str]) -> list[tuple[str, int, int]]:
    """Runs of equal labels: (label, first, last)."""
    out: list[tuple[str, int, int]] = []
    for i, x in enumerate(labels):
        if out and out[-1][0] == x:
            out[-1] = (x, out[-1][1], i)
        else:
            out.append((x, i, i))
    return out


def decode_all(model: Model, texts: list[str | None]) -> list[list[tuple[str, str, int, int]]]:
    """Hits of some texts, tagged together; nulls have none."""
    tokens = [tokenize(t or "") for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int64)])
    path = viterbi_all(model.emit(pa.array([w for t in tokens for w, _, _ in t], pa.string()), bounds), bounds, model.transitions).tolist()
    return [_hits(t or "", toks, [model.labels[k] for k in path[a:b]]) for t, toks, a, b in zip(texts, tokens, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def decode(model: Model, text: str) -> list[tuple[str, str, int, int]]:
    return decode_all(model, [text])[0]


def _hits(text: str, tokens: list[tuple[str, int, int]], labels: list[str]) -> list[tuple[str, str, int, int]]:
    """Label runs that pass the checks, with names split from the addresses that follow them."""
    raw = text.encode()
    hits = []
    for kind, i, j in spans(labels):
        a, b = tokens[i][1], tokens[j][2]
        if kind in KINDS and _valid(kind, span := raw[a:b].decode()):
            hits.append((kind, span, a, b))
    names = []
    for n, (kind, span, a, b) in enumerate(hits):
        if kind != "ADDRESS":
            continue
        name, place = None, (a, a)
        cut = name_prefix(span)
        if cut is not None:
            found = span.encode()[:cut].decode().rstrip()
            if found and has_name_signal(found):
                name, place = found, (a, a + len(found.encode()))
        if name is None and a:
            lo = _rise(raw, max(0, a - 40))
            lead = raw[lo:a].decode().rstrip()
            found = leading_name(lead)
            if found and has_name_signal(found):
                name, place = found, (lo + max(0, lead.encode().rfind(found.encode())), a)
        if name is None:
            continue
        names.append(("NAME", name, *place))
        if span.startswith(name):
            rest = span[len(name) :].lstrip()
            hits[n] = (kind, rest, a + len(span.encode()) - len(rest.encode()), b)
    return hits + names


__all__ = ["Model", "decode", "decode_all", "leading_name", "name_prefix", "shape", "token_features", "tokenize", "viterbi", "viterbi_all", "_cut"]
