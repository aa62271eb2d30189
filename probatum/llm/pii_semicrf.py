"""Personal data by a semi-Markov conditional random field beside fixed patterns.

Base spans follow four patterns, each found by scans that are linear in the text. The method adds spans:
a text's islands (neighbouring tokens with a digit, @ or a bracketed "at") are cut into atoms; every run of
at most MAX_ATOMS atoms that can be of a kind is a candidate segment with features of the whole span (digit
count, grouping, checksum, brackets, what stands on both sides, the word before); a dynamic programme over
atoms chooses boundaries and kinds together. Outside islands no candidate exists, so decoding islands one
by one equals decoding the whole text. Weights are fitted here by likelihood, with forward-backward sums,
on seeded synthetic sentences; fitting takes seconds and is the same on every run.
A candidate has at most MAX_ATOMS atoms and 320 characters, and a word before a bracketed "at" joins its island up
to 64 characters: longer ones aren't what the field knows. Base spans have no such bound.

Base spans stay whatever the decoder says; decoded spans that overlap none of them are added.

Defined cases: a null text is empty and has no spans; spans count code points, the end exclusive; repeated
rows are treated one by one; an empty table gives an empty result; further columns aren't read.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache
from itertools import accumulate
from math import exp, log

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import slices

KINDS = ("email", "ip", "card", "phone")
MAX_ATOMS = 24

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind): leftmost non-overlapping matches of each kind that pass its test."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    at = 0
    while m := _RUN.search(text, at):
        at = m.end()
        # A match that starts later in this run of digits would go on in the same way.
        if at < len(text) and text[at] == "." and (m := _IP.match(text, m.start())):
            at = m.end()
            if all(len(p := part.lstrip("0")) < 4 and int(p or "0") <= 255 for part in m[0].split(".")):
                out.append((m.start(), at, "ip"))
    for m in _CARD.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() < 60 else ""
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), m.end(), "phone"))
        at = text.find("+", m.end() if m else at + 1)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field -------------------------------------------------------------------------------------

ANCHOR = r"[0-9@]|[\[({]at[\])}]"
_ANCHOR = re.compile(ANCHOR)
_NEXT = re.compile(r" (?:[+(]+ )?(\S+)")
_LEAD = re.compile(r"([A-Za-z0-9._%+-]{1,64} |[+(]+ )\Z")
_BRACKET_AT = re.compile(r"[\[({]at[\])}]")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]+(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9]{4,19}(?:[ .-]?[0-9]{2,6})*"),
    "phone": re.compile(r"\+?(?:\([0-9]{2,4}\)|[0-9]{1,4})(?:[ ./-]{0,2}\(?[0-9]{2,5}\)?){1,5}"),
}
#: Words that announce a kind.
_CUES = {"email": {"mail", "email", "e-mail", "contact"}, "ip": {"ip", "host", "server", "address"}, "card": {"card", "visa", "mastercard", "amex"}, "phone": {"phone", "tel", "call", "fax", "mobile", "cell", "telephone"}}


def features(kind: str, span: str, before: str, after: str, word: str) -> list[str]:
    """Of a whole candidate span and what stands around it."""
    d = digits_of(span)
    groups = re.findall(r"[0-9]+", span) if kind != "email" else []
    f = ["bias", f"digits={min(len(d), 20)}", f"groups={min(len(groups), 6)}", f"left={'edge' if not before or before.isspace() or before in '([:,;' else 'glued'}", f"right={'edge' if not after or after.isspace() or after in ')],;:!?' else 'dot' if after == '.' else 'glued'}"]
    if word in _CUES[kind]:
        f.append("cue")
    if kind in ("card", "phone"):
        seps = "".join(sorted(set(re.sub(r"[0-9]", "", span))))
        f += [f"seps={seps}", f"shape={'-'.join(str(len(g)) for g in groups)[:20]}", f"plus={span[0] == '+'}", f"open={span.count('(') != span.count(')')}"]
    if kind == "card":
        f.append(f"luhn={luhn(d)}")
    if kind == "ip":
        f.append(f"octets={all(int(p) <= 255 for p in groups)}")
    if kind == "email":
        tail = re.split(r"[.\])} ]", span)[-1]
        f += [f"at={'@' in span}", f"tail={tail.isalpha() and 2 <= len(tail) <= 6}", f"start={span[0].isalnum()}"]
    return [f"{kind}:{x}" for x in f]


def candidates(island: str, before: str, after: str) -> tuple[list[str], dict[int, list]]:
    """Atoms of an island, and for each atom the candidate segments that end with it: (first, kind, features)."""
    atoms = _ATOM.findall(island)
    at = [0]
    for a in atoms:
        at.append(at[-1] + len(a))
    ends: dict[int, list] = {}
    words = before.split()
    number = [a[0].isdigit() and a.isascii() for a in atoms]
    plain = [x or a in " ()+./-" for x, a in zip(number, atoms, strict=True)]
    signs = {k for k, a in enumerate(atoms) if a == "@" or a == "at" and 0 < k < len(atoms) - 1 and atoms[k - 1] in "[({" and atoms[k + 1] in "])}"}

    def offer(i, j, kind):
        if at[j] - at[i] <= 320 and _SHAPES[kind].fullmatch(island, at[i], at[j]):
            word = (island[max(0, at[i] - 24) : at[i]].split() or words or [""])[-1].strip(".:,;").lower()
            ends.setdefault(j, []).append((i, kind, features(kind, island[at[i] : at[j]], island[at[i] - 1] if at[i] else before[-1:], island[at[j]] if at[j] < len(island) else after[:1], word)))

    for i, a in enumerate(atoms):
        if number[i] or a in "+(":
            n = 0
            for j in range(i + 1, min(len(atoms), i + MAX_ATOMS) + 1):
                if not plain[j - 1]:
                    break
                n += len(atoms[j - 1]) * number[j - 1]
                if n > 19:
                    break
                if number[j - 1] or atoms[j - 1] == ")":
                    for kind, low, high in (("ip", 4, 12), ("card", 13, 19), ("phone", 7, 15)):
                        if low <= n <= high:
                            offer(i, j, kind)
    for k in sorted(signs):
        firsts, i = [], k - 1
        while i >= max(0, k - MAX_ATOMS + 2) and (atoms[i][0].isalnum() and atoms[i].isascii() or atoms[i] in "._%+-[({ "):
            if i < k and atoms[i] not in "[({ ":
                firsts.append(i)
            elif atoms[i] == " " and firsts:
                break
            i -= 1
        for j in range(k + 2, min(len(atoms), k + MAX_ATOMS) + 1):
            last = atoms[j - 1]
            if not (last[0].isalnum() and last.isascii() or last in ".-[({])} "):
                break
            if last[0].isalnum():
                for i in firsts:
                    if j - i <= MAX_ATOMS:
                        offer(i, j, "email")
    return atoms, ends


def _plus(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + log(1 + exp(b - a)) if b > a - 40 else a


NEVER = -1e30
OUT = {"d": "out:digits", "o": "out:other"}


def _outside(atom: str) -> str:
    return OUT["d"] if atom[0].isdigit() else OUT["o"]


def _segments(atoms, ends, w):
    """(end, start, is an entity, kind, features, score)"""
    for j in range(1, len(atoms) + 1):
        o = _outside(atoms[j - 1])
        yield j, j - 1, 0, None, [o], w.get(o, 0.0)
        for i, kind, f in ends.get(j, ()):
            yield j, i, 1, kind, f, sum(w.get(x, 0.0) for x in f)


def decode(island: str, before: str, after: str, w: dict) -> list[tuple[int, int, str]]:
    """The best segmentation: a bounded-length dynamic programme with one state for 'an entity ends here'."""
    atoms, ends = candidates(island, before, after)
    if not ends:
        return []
    best = [[0.0, NEVER]] + [[NEVER, NEVER] for _ in atoms]
    back: dict = {}
    for j, i, e, kind, _, score in _segments(atoms, ends, w):
        for s in (0, 1):
            v = best[i][s] + score + (w.get("adjacent", 0.0) if e and s else 0.0)
            if v > best[j][e]:
                best[j][e], back[j, e] = v, (i, s, kind)
    at = [0]
    for a in atoms:
        at.append(at[-1] + len(a))
    j, e, out = len(atoms), int(best[-1][1] > best[-1][0]), []
    while j:
        i, s, kind = back[j, e]
        if kind:
            out.append((at[i], at[j], kind))
        j, e = i, s
    return out[::-1]


def gradient(island: str, before: str, after: str, gold: list, w: dict) -> dict:
    """Gold minus expected feature counts."""
    atoms, ends = candidates(island, before, after)
    at = [0]
    for a in atoms:
        at.append(at[-1] + len(a))
    n, g = len(atoms), {}
    segs = list(_segments(atoms, ends, w))
    adj = w.get("adjacent", 0.0)
    alpha = [[0.0, NEVER]] + [[NEVER, NEVER] for _ in atoms]
    for j, i, e, _, _, score in segs:
        for s in (0, 1):
            alpha[j][e] = _plus(alpha[j][e], alpha[i][s] + score + adj * (e and s))
    beta = [[NEVER, NEVER] for _ in range(n)] + [[0.0, 0.0]]
    for j, i, e, _, _, score in reversed(segs):
        for s in (0, 1):
            beta[i][s] = _plus(beta[i][s], beta[j][e] + score + adj * (e and s))
    z = _plus(*alpha[n])
    want = {(a, b, k) for a, b, k in gold}
    inside, last = set(), None
    for a, b, _ in gold:
        inside.update(range(a, b))
    for j, i, e, kind, f, score in segs:
        is_gold = (at[i], at[j], kind) in want if e else at[i] not in inside
        for s in (0, 1):
            p = exp(min(0.0, alpha[i][s] + score + adj * (e and s) + beta[j][e] - z))
            for x in f:
                g[x] = g.get(x, 0.0) - p
            if e and s:
                g["adjacent"] = g.get("adjacent", 0.0) - p
        if is_gold:
            for x in f:
                g[x] = g.get(x, 0.0) + 1
            if e and last == at[i]:
                g["adjacent"] = g.get("adjacent", 0.0) + 1
            last = at[j] if e else None
    return g


def sentences(seed: int, n: int):
    """Seeded synthetic sentences: (text, gold spans), with look-alikes that are no personal data."""
    rnd = random.Random(seed)
    num = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(rnd.randint(2, 8)))

    def card():
        d = rnd.choice("3456") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        s = rnd.choice(["", "", " ", "-", "."])
        return s.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = rnd.choice("23456789") + num(2), num(3), num(4)
        return rnd.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+44 {num(4)} {num(6)}", f"+{rnd.randint(1, 99)} {a} {b} {c}", f"({a}) {b} {c}", f"1-{a}-{b}-{c}", f"{a}.{b}.{c}"])

    def email():
        a, b = name() + rnd.choice(["", ".", "_", "-"]) + rnd.choice([name(), num(2)]), name() + rnd.choice(["", num(1)])
        return rnd.choice(["{}@{}.com", "{}@mail.{}.org", "{}@{}.example.com", "{} [at] {} [dot] com", "{}[at]{}.net", "{} (at) {} (dot) org", "{}(at){}.example.com"]).format(a, b)

    good = {"card": card, "phone": phone, "email": email, "ip": lambda: ".".join(str(rnd.randint(0, 255)) for _ in range(4))}

    def bad_card():
        d = num(15)
        return d + rnd.choice([c for c in "0123456789" if not luhn(d + c)])

    bad = [lambda: num(rnd.randint(1, 6)), lambda: f"{rnd.randint(1, 9)}.{num(1)}", lambda: f"20{num(2)}-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", bad_card, lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(40)), lambda: f"{num(3)},{num(3)}", lambda: num(rnd.randint(7, 13)), lambda: f"{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(4)}-{num(4)}", lambda: ".".join(str(rnd.randint(256, 999)) for _ in range(4)), lambda: f"{name()}@{name()}", lambda: f"@{name()}{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(3)} {num(3)} {num(2)}", lambda: f"{num(4)} {num(4)}", lambda: f"AKIA{num(6)}XY{num(2)}", lambda: f"({num(4)})", lambda: f"[{num(2)}]", lambda: f"{num(4)}–{num(4)}", lambda: f"ISBN 978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", lambda: f"{num(2)} {num(3)} {num(3)} {num(3)}"]
    for _ in range(n):
        text, gold = " ".join(name() for _ in range(rnd.randint(1, 4))) + " ", []
        for _ in range(rnd.randint(1, 3)):
            if rnd.random() < 0.5:
                kind = rnd.choice(KINDS)
                if rnd.random() < 0.3:
                    text += rnd.choice(sorted(_CUES[kind])) + rnd.choice([": ", " "])
                s = good[kind]()
                gold.append((len(text), len(text) + len(s), kind))
            else:
                s = rnd.choice(bad)()
            text += s + rnd.choice([" ", ". ", ", ", " "]) + name() + " "
        yield text, gold


def _anchored(token: str) -> bool:
    return bool(_ANCHOR.search(token)) or token[1:4] == "dot"


def islands(text: str):
    """(start, island, text before, text after): neighbouring tokens around anchors, in linear time."""
    at = 0
    while m := _ANCHOR.search(text, at):
        start = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        lead = _LEAD.search(text, max(at, start - 66), start)
        if lead and (lead[1][0] in "+(" or _BRACKET_AT.match(text, start)):
            start = lead.start()
        end = m.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        spare = 0
        while n := _NEXT.match(text, end):
            if _anchored(n[1]):
                spare = 0
            elif spare or not _BRACKET_AT.search(text, max(start, end - 5), end) and text[end - 4 : end - 1] != "dot" and not _BRACKET_AT.match(text, n.end() + 1) and text[n.end() + 2 : n.end() + 5] != "dot":
                break
            else:
                spare = 1
            end = n.end()
        yield start, text[start:end], text[max(0, start - 24) : start], text[end : end + 2]
        at = end


@cache
def weights(seed: int = 5, n: int = 800, epochs: int = 6, rate: float = 0.25, decay: float = 0.002) -> dict:
    """Fitted by stochastic gradient steps on the log-likelihood; the same for the same arguments."""
    w: dict[str, float] = {}
    data = [(island, before, after, [(a - s, b - s, k) for a, b, k in gold if s <= a and b <= s + len(island)]) for text, gold in sentences(seed, n) for s, island, before, after in islands(text)]
    for epoch in range(epochs):
        random.Random(epoch).shuffle(data)
        for island, before, after, gold in data:
            for x, v in gradient(island, before, after, gold, w).items():
                w[x] = w.get(x, 0.0) * (1 - decay) + rate / (1 + epoch) * v
    return w


def all_spans(text: str, w: dict) -> tuple[list, list]:
    """(base spans, base and added spans)."""
    base = base_spans(text)
    out, order, j = list(base), sorted(base), 0
    reach = list(accumulate((e for _, e, _ in order), max))  # how far the first spans go
    for s, island, before, after in islands(text):
        for a, b, kind in decode(island, before, after, w):
            while j < len(order) and order[j][0] < s + b:
                j += 1
            if not j or reach[j - 1] <= s + a:
                out.append((s + a, s + b, kind))
    return base, sorted(out, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


EMPTY = hashlib.sha256(b"").hexdigest()


def _found(texts: pa.Array, w: dict) -> dict[int, tuple[list, list, str]]:
    """Spans of the texts that have an anchor at all, by position."""
    at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, ANCHOR), False))
    return {i: (*all_spans(t, w), t) for i, t in zip(at.to_pylist(), texts.take(at).to_pylist(), strict=True)}


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind> and base_sha256 of base spans, n_added and all spans of every document."""
    w = weights()

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                n, got = batch.num_rows, _found(batch.column("text"), w)
                counts = {k: [0] * n for k in KINDS}
                sha, spans, added = [EMPTY] * n, [""] * n, [0] * n
                for i, (base, every, _) in got.items():
                    for _, _, k in base:
                        counts[k][i] += 1
                    sha[i] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[i], added[i] = joined(every), len(every) - len(base)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(sha), pa.array(spans), pa.array(added, pa.int64())], ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    slim = docs.select("doc_id", (F.col("text") if "text" in docs.columns else F.lit(None)).cast("string").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    return slim.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long")


def masked(text: str, spans: list) -> str:
    """Each span, or run of overlapping spans, becomes the name of its first kind in brackets."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The same columns with personal data masked in text, and n_chars, where it exists, counted anew."""
    if "text" not in docs.columns:
        return docs
    w, names = weights(), docs.columns

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                column = batch.column("text")
                got = {i: masked(t, every) for i, (_, every, t) in _found(column, w).items() if every}
                if not got:
                    yield batch
                    continue
                texts = column.to_pylist()
                for i, t in got.items():
                    texts[i] = t
                arrays = [pa.array(texts, column.type) if c == "text" else batch.column(c) for c in names]
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out
