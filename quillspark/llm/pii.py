"""Personal data: exact base patterns and a character-level bidirectional LSTM with a CRF.

base_spans() finds e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone
numbers by fixed patterns. SpanTagger is a BiLSTM over character classes with CRF transitions, trained
in numpy from labelled spans; it adds spans the patterns miss (numbers without "+", say) and never
takes one away. Every span needs a digit or "@", so only the text around those is tagged: segments
are cut into overlapping windows, each window is scored, scores of a character are averaged over its
windows with weights that fall towards the window's ends, and one Viterbi pass over the whole segment
decides. A tagged e-mail is widened to the ends of its address, which may lie outside the segment.
A tagged span is kept if its kind's form holds and it meets no base span.

fit() reads a bounded sample: windows around digits and "@" of up to max_docs documents (drawn by a
hash of the text), labelled by the base patterns; spans are also rewritten in other
usual forms and moved between words of other texts. Without such documents the tagger is trained on rewritten examples alone.

Null and empty texts hold nothing. Offsets are code points, ends exclusive. Equal starts are ordered
by kind: email, ip, card, phone. Rows repeat as they come. find() ignores extra columns, mask() keeps them.
An empty table gives no row; training on one uses the built-in examples. Long stretches of digits are decoded
alone, short ones together up to CELLS characters.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

KINDS = ("email", "ip", "card", "phone")
_GATE = re.compile("[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _emails(text: str):
    """Leftmost non-overlapping addresses, found from each "@" outwards in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, begin)
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number), by start, then kind."""
    if not _GATE.search(text):
        return []
    out = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((*m.span(), 1))
    for m in _CARD.finditer(text):
        d = "".join(_DIGITS.findall(m.group()))
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((*m.span(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                out.append((*m.span(), 3))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


# ---------------------------------------------------------------- the tagger

_SINGLE = "@.-+()_%/:=\"',;#&$*!?|<>[]{}"
CLASSES = 8 + len(_SINGLE)
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
WINDOW, STRIDE, MARGIN = 96, 48, 20
CELLS = 20_000  # characters decoded at once, padding counted, but for a longer segment


def _class_table() -> np.ndarray:
    t = np.full(0x250, 7, np.int64)
    for c in range(0x250):
        ch = chr(c)
        if "0" <= ch <= "9":
            t[c] = 1
        elif "a" <= ch <= "f":
            t[c] = 2
        elif ch.islower():
            t[c] = 3
        elif ch.isupper():
            t[c] = 4
        elif ch in "\n\r":
            t[c] = 5
        elif ch.isspace():
            t[c] = 6
        elif ch in _SINGLE:
            t[c] = 8 + _SINGLE.index(ch)
    return t


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(p < 0x250, _TABLE[np.minimum(p, 0x24F)], 7)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class SpanTagger:
    """BiLSTM-CRF; all arrays are small and fixed in size."""

    def __init__(self, hidden: int = 16, dim: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)
        g = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.h = hidden
        self.p = {"emb": rng.normal(0, 0.5, (CLASSES, dim)), "out": g(2 * hidden, TAGS), "outb": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}
        for side in "fb":
            self.p |= {f"w{side}": g(dim, 4 * hidden), f"u{side}": g(hidden, 4 * hidden), f"b{side}": np.concatenate([np.ones(hidden), np.zeros(3 * hidden)])}
        # fixed: inside follows its own begin or inside, and no text starts inside
        self.ban = np.zeros((TAGS, TAGS))
        for k in range(len(KINDS)):
            self.ban[:, 2 + 2 * k] = -1e4
            self.ban[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
        self.ban0 = np.zeros(TAGS)
        self.ban0[2::2] = -1e4

    def _pass(self, x: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states, time first; x: time x batch x dim, already turned for the backward side."""
        p, h = self.p, self.h
        z_in = x @ p[f"w{side}"] + p[f"b{side}"]
        hs, cs = np.zeros((x.shape[1], h)), np.zeros((x.shape[1], h))
        out = np.empty((x.shape[0], x.shape[1], h))
        for t in range(x.shape[0]):
            z = z_in[t] + hs @ p[f"u{side}"]
            gates, cand = _sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            f, i, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            c = f * cs + i * cand
            tc = np.tanh(c)
            if keep is not None:
                keep.append((f, i, o, cand, cs, tc, hs))
            hs, cs = o * tc, c
            out[t] = hs
        return out

    def emissions(self, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores, time x batch x tags, of class ids batch x time."""
        x = self.p["emb"][ids.T]
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._pass(x, "f", kf)
        hb = self._pass(x[::-1], "b", kb)[::-1]
        both = np.concatenate([hf, hb], axis=2)
        if keep is not None:
            keep |= {"x": x, "f": kf, "b": kb, "both": both}
        return both @ self.p["out"] + self.p["outb"]

    def _grad_pass(self, x, side, keep, dh_all, grads):
        p, h = self.p, self.h
        dh, dc = np.zeros_like(dh_all[0]), np.zeros_like(dh_all[0])
        dz_all = np.empty((x.shape[0], x.shape[1], 4 * h))
        for t in range(x.shape[0] - 1, -1, -1):
            f, i, o, cand, c0, tc, h0 = keep[t]
            dh = dh + dh_all[t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = dz_all[t]
            dz[:, :h] = dc * c0 * f * (1 - f)
            dz[:, h : 2 * h] = dc * cand * i * (1 - i)
            dz[:, 2 * h : 3 * h] = dh * tc * o * (1 - o)
            dz[:, 3 * h :] = dc * i * (1 - cand * cand)
            grads[f"u{side}"] += h0.T @ dz
            dh, dc = dz @ p[f"u{side}"].T, dc * f
        flat = dz_all.reshape(-1, 4 * h)
        grads[f"w{side}"] += x.reshape(-1, x.shape[2]).T @ flat
        grads[f"b{side}"] += flat.sum(axis=0)
        return dz_all @ p[f"w{side}"].T

    def loss(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log-likelihood of the tags under the CRF, and its gradients."""
        keep: dict = {}
        e = self.emissions(ids, keep)
        n_t, n_b, _ = e.shape
        a, s0 = self.p["trans"] + self.ban, self.p["start"] + self.ban0
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + s0
        ea = np.exp(a)
        for t in range(1, n_t):
            m = alpha[t - 1].max(axis=1, keepdims=True)
            alpha[t] = np.log(np.exp(alpha[t - 1] - m) @ ea + 1e-300) + m + e[t]
        for t in range(n_t - 2, -1, -1):
            v = beta[t + 1] + e[t + 1]
            m = v.max(axis=1, keepdims=True)
            beta[t] = np.log(np.exp(v - m) @ ea.T + 1e-300) + m
        m = alpha[-1].max(axis=1, keepdims=True)
        z = np.log(np.exp(alpha[-1] - m).sum(axis=1, keepdims=True)) + m
        y = tags.T
        gold = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0].sum(axis=0) + s0[y[0]] + a[y[:-1], y[1:]].sum(axis=0)
        de = np.exp(np.clip(alpha + beta - z, -700, 0))
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["start"] = de[0].sum(axis=0) - np.bincount(y[0], minlength=TAGS)
        left, right = alpha[:-1] - z, e[1:] + beta[1:]
        ml, mr = left.max(axis=2, keepdims=True), right.max(axis=2, keepdims=True)
        scale = np.exp(np.clip(ml + mr, -700, 700))
        g["trans"] = np.einsum("tbi,tbj->ij", np.exp(left - ml) * scale, np.exp(right - mr)) * ea
        np.subtract.at(g["trans"], (y[:-1].ravel(), y[1:].ravel()), 1)
        np.put_along_axis(de, y[:, :, None], np.take_along_axis(de, y[:, :, None], 2) - 1, 2)
        flat = keep["both"].reshape(-1, 2 * self.h)
        g["out"], g["outb"] = flat.T @ de.reshape(-1, TAGS), de.sum(axis=(0, 1))
        dboth = de @ self.p["out"].T
        dx = self._grad_pass(keep["x"], "f", keep["f"], dboth[:, :, : self.h], g)
        dx = dx + self._grad_pass(keep["x"][::-1], "b", keep["b"], dboth[::-1, :, self.h :], g)[::-1]
        np.add.at(g["emb"], ids.T.ravel(), dx.reshape(-1, dx.shape[2]))
        return float((z[:, 0] - gold).mean()), {k: v / n_b for k, v in g.items()}

    def train(self, ids: np.ndarray, tags: np.ndarray, steps: int = 220, batch: int = 48, rate: float = 0.02, seed: int = 7) -> list[float]:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(ids), batch)
            loss, g = self.loss(ids[pick], tags[pick])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            r = rate * min(1, 5 / max(norm, 1e-9)) * (1 - 0.9 * step / steps)
            for k, x in g.items():
                m[k] = 0.9 * m[k] + 0.1 * x
                v2[k] = 0.99 * v2[k] + 0.01 * x * x
                self.p[k] -= r * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)
            losses.append(loss)
        return losses

    def decode(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """Tags of each segment of class ids: windows scored, averaged, and one Viterbi pass over all."""
        owner, first, rows = [], [], []
        for s, ids in enumerate(segments):
            for at in range(0, max(1, len(ids) - (WINDOW - STRIDE)), STRIDE):
                row = np.zeros(WINDOW, np.int64)
                part = ids[at : at + WINDOW]
                row[: len(part)] = part
                owner.append(s), first.append(at), rows.append(row)
        weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(float)[:, None]
        total = [np.zeros((len(s), TAGS)) for s in segments]
        mass = [np.zeros((len(s), 1)) for s in segments]
        for lo in range(0, len(rows), 256):
            e = self.emissions(np.array(rows[lo : lo + 256]))
            for k in range(e.shape[1]):
                s, at = owner[lo + k], first[lo + k]
                n = min(WINDOW, len(segments[s]) - at)
                total[s][at : at + n] += e[:n, k] * weight[:n]
                mass[s][at : at + n] += weight[:n]
        score = [a / b for a, b in zip(total, mass, strict=True)]
        out: list = [None] * len(segments)
        order = sorted(range(len(segments)), key=lambda s: len(segments[s]))
        while order:  # the longest with as many others as CELLS allow, so that padding stays small
            part = order[-max(1, CELLS // max(1, len(segments[order[-1]]))) :]
            del order[-len(part) :]
            for s, path in zip(part, self._viterbi([score[s] for s in part]), strict=True):
                out[s] = path
        return out

    def _viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        most, a = max(len(s) for s in scores), self.p["trans"] + self.ban
        e = np.zeros((most, len(scores), TAGS))
        for k, s in enumerate(scores):
            e[: len(s), k] = s
            e[len(s) :, k, 1:] = -1e4  # past the end: outside
        back = np.zeros((most, len(scores), TAGS), np.int8)
        v = e[0] + self.p["start"] + self.ban0
        for t in range(1, most):
            w = v[:, :, None] + a
            back[t] = w.argmax(axis=1)
            v = np.take_along_axis(w, back[t][:, None, :].astype(np.int64), 1)[:, 0] + e[t]
        tag = v.argmax(axis=1)
        path = np.empty((most, len(scores)), np.int64)
        for t in range(most - 1, -1, -1):
            path[t] = tag
            tag = back[t][np.arange(len(scores)), tag]
        return [path[: len(s), k] for k, s in enumerate(scores)]


def segments_of(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and "@", with MARGIN characters at either side, joined where they meet."""
    out: list[list[int]] = []
    for m in re.finditer(r"[0-9@](?:[^0-9@]{0,8}[0-9@])*", text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _well_formed(kind: int, span: str) -> bool:
    digits = "".join(_DIGITS.findall(span))
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+ ?@ ?[^\s@]+\.[A-Za-z]{2,}", span))
    if kind == 1:
        return bool(re.fullmatch(r"[0-9]{1,3}([., ]+[0-9]{1,3}){3}", span))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[^0-9 .-]", span)
    return 9 <= len(digits) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", span)) and bool(re.search(r"[ ().-]", span))


def _widened(text: str, a: int, b: int, base: list) -> tuple[int, int]:
    """A tagged e-mail with the rest of its address, which a segment may have cut; base spans bound it."""
    low = max((s[1] for s in base if s[1] <= a), default=0)
    high = min((s[0] for s in base if s[0] >= b), default=len(text))
    while a > low and (text[a - 1].isalnum() or text[a - 1] in "._%+-"):
        a -= 1
    while b < high and (text[b].isalnum() or text[b] == "-" or text[b] == "." and b + 1 < high and text[b + 1].isalnum()):
        b += 1
    return a, b


def all_spans(texts: list[str], tagger: SpanTagger) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, both (start, end, kind) in order."""
    base = [base_spans(t) for t in texts]
    where, ids = [], []
    for i, t in enumerate(texts):
        if _GATE.search(t):
            for a, b in segments_of(t):
                where.append((i, a))
                ids.append(classes_of(t[a:b]))
    added: dict[int, list] = {}
    if ids:
        for (i, a), tags in zip(where, tagger.decode(ids), strict=True):
            begins = np.flatnonzero(tags % 2 == 1)
            for s in begins.tolist():
                e = s + 1
                while e < len(tags) and tags[e] == tags[s] + 1:
                    e += 1
                kind = int(tags[s]) // 2
                first, last = _widened(texts[i], a + s, a + e, base[i]) if kind == 0 and "@" in texts[i][a + s : a + e] else (a + s, a + e)
                if _well_formed(kind, texts[i][first:last]):
                    added.setdefault(i, []).append((first, last, kind))
    out = []
    for i, own in enumerate(base):
        new = [s for s in added.get(i, []) if all(s[1] <= b[0] or b[1] <= s[0] for b in own)]
        out.append((own, sorted({*own, *new}, key=lambda s: (s[0], s[2], s[1]))))
    return out


def rewritten(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list]:
    """The text with phones and cards in other usual forms, and where the spans are then."""
    out, done, new = [], 0, []
    size = 0
    for a, b, k in spans:
        if a < done:
            continue
        piece = text[a:b]
        d = "".join(_DIGITS.findall(piece))
        if k == 3 and len(d) >= 10:
            x, y, z = d[-10:-7], d[-7:-4], d[-4:]
            piece = [f"({x}) {y}-{z}", f"{x}-{y}-{z}", f"{x}.{y}.{z}", f"00{d[:-10]} {x} {y} {z}", piece][rng.integers(5)]
        elif k == 2:
            piece = [".".join(d[i : i + 4] for i in range(0, len(d), 4)), " ".join(d[i : i + 4] for i in range(0, len(d), 4)), piece][rng.integers(3)]
        elif k == 0:
            piece = [piece.upper(), piece.replace("@", " @ "), piece, piece][rng.integers(4)]
        out += [text[done:a], piece]
        size += a - done
        new.append((size, size + len(piece), k))
        size += len(piece)
        done = b
    return "".join([*out, text[done:]]), new


_EXAMPLES = (  # fixed values: one filled-in form of each kind, and look-alikes that are none
    "write to ann.lee@mail.example.com or call +1 (212) 555-0147 today",
    "from 10.20.30.40 card 4539 1488 0343 6467 was used",
    "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" and password=b7db7aa4a5fcc78305",
    "Apache License, Version 2.0. CC BY-NC 4.0 in 2024, key AKIAMD62HKU6VBLCCCE",
)


def fit(docs: DataFrame, text_col: str = "text", max_docs: int = 1200, steps: int = 400) -> SpanTagger:
    """Train on windows of a bounded sample of documents; see the module."""

    def windows(batches):
        for batch in batches:
            out = []
            for t in batch.column(0).to_pylist():
                if t and _GATE.search(t):
                    segs = segments_of(t)
                    pick = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
                    a, b = segs[pick % len(segs)]
                    out.append(t[max(0, a - 20) : min(len(t), a - 20 + 2 * WINDOW)])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["w"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(tidy(windows), "w string").distinct()
    texts = [r["w"] for r in rows.orderBy(F.xxhash64("w"), "w").limit(max_docs).collect()]
    return train_tagger(texts, steps)


def moved(text: str, spans: list[tuple[int, int, int]], around: list[str], rng: np.random.Generator) -> tuple[str, list]:
    """One of the text's spans between words of other texts, so that its form tells more than its neighbours."""
    a, b, k = spans[rng.integers(len(spans))]
    before, after = (around[rng.integers(len(around))] for _ in range(2))
    left = before[-int(rng.integers(1, 40)) :].rstrip() + (" ", ": ", " (", ", ", "\n")[rng.integers(5)]
    right = (" ", ", ", ".", ") ", "; ", "\n")[rng.integers(6)] + after[: int(rng.integers(1, 40))].lstrip()
    return left + text[a:b] + right, [(len(left), len(left) + b - a, k)]


def train_tagger(texts: list[str], steps: int = 400) -> SpanTagger:
    rng = np.random.default_rng(11)
    ids, tags, around = [], [], [""]
    texts = [*texts, *_EXAMPLES * max(1, (200 - len(texts)) // 4)]
    for t in texts:  # words that stand between spans, without digits
        done = 0
        for a, b, _ in [*base_spans(t), (len(t), len(t), 0)]:
            around += [x for x in re.split("[0-9@]+", t[done:a]) if len(x) > 3]
            done = max(done, b)
    for t in texts:
        spans = base_spans(t)
        forms = [(t, spans), rewritten(t, spans, rng)]
        if spans:
            forms += [moved(*forms[i], around, rng) for i in (0, 1, 1)]
        for text, spans in forms:
            for at in range(0, max(1, len(text) - WINDOW // 2), WINDOW):
                c = classes_of(text)[at : at + WINDOW]
                row, tag = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
                row[: len(c)] = c
                free = np.zeros(len(text) + 1, bool)
                for a, b, k in spans:
                    if free[a:b].any():
                        continue
                    free[a:b] = True
                    for p in range(max(a, at), min(b, at + WINDOW)):
                        tag[p - at] = 1 + 2 * k if p in (a, at) else 2 + 2 * k
                ids.append(row), tags.append(tag)
    tagger = SpanTagger()
    tagger.train(np.array(ids), np.array(tags), steps)
    return tagger


def _listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find(df: DataFrame, tagger: SpanTagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base and spans: arrays of struct<kind, start, end> of the base patterns and of all."""
    held = df.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            got = all_spans([t or "" for t in batch.column(1).to_pylist()], held.value)
            cols = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in g[which]] for g in got], kind) for which in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=[id_col, "base", "spans"])

    one = "array<struct<kind:string,start:bigint,end:bigint>>"
    rows = df.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"{id_col} long, base {one}, spans {one}")


def mask(df: DataFrame, tagger: SpanTagger, text_col: str = "text") -> DataFrame:
    """df with every found span of its text replaced by its kind in brackets, as [EMAIL]."""
    held = df.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        for batch in batches:
            k = batch.schema.names.index(text_col)
            texts = batch.column(k).to_pylist()
            new = []
            for t, (_, spans) in zip(texts, all_spans([t or "" for t in texts], held.value), strict=True):
                if spans:
                    parts, done = [], 0
                    for a, b, kind in spans:
                        if a >= done:
                            parts += [t[done:a], f"[{KINDS[kind].upper()}]"]
                        done = max(done, b)
                    t = "".join([*parts, t[done:]])
                new.append(t)
            cols = list(batch.columns)
            cols[k] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return df.mapInArrow(tidy(run), df.schema)
