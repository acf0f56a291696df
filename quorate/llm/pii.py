"""PII by weak supervision: labelers vote on candidate spans, EM estimates their reliability, a classifier decides.

The base patterns always count. Wider candidates (mail addresses written with (at), numbers in other layouts) get votes
of pattern, checksum, gazetteer, context and shape labelers; only the counts of vote patterns, a table bounded by
4 kinds * 3**5 patterns, go to the driver, where expectation-maximisation and the span classifier are fitted on them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, saved

KINDS = ("email", "ip", "card", "phone")
#: Digits before an address would be part of it, so an address is looked for at the first of a run of digits only.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
WIDE = {
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9.,])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./-]?[0-9]{4}){2}[ ./-]?[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9])(?:00[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"),
}
#: What stands left of the mark in a mail address, the mark, and what stands right of it; in the base form and the wide one.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
MARK, WIDE_MARK = re.compile("@"), re.compile(r"@|\(at\)|\[at\]")
DOMAIN, WIDE_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[ ]?[A-Za-z0-9-]+(?:[ ]?(?:\.|\(dot\)|\[dot\])[ ]?[A-Za-z0-9-]+)+")
#: Gazetteers: mail domains' last parts, first digits of card issuers, and words that announce a kind.
DOMAINS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu", "us"}
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "36", "38", "35")
CUES = {
    "email": re.compile(r"\b(e-?mail|mail|contact|contacto|correo|courriel|kontakt|write|an)\b", re.I),
    "ip": re.compile(r"\b(ip|host|server|address|addr|adresse|servidor|serveur)\b", re.I),
    "card": re.compile(r"\b(card|credit|visa|mastercard|carte|karte|tarjeta|pay|account)\b", re.I),
    "phone": re.compile(r"\b(phone|tel|telephone|call|mobile|fax|telefon|anruf|teléfono|téléphone)\b", re.I),
}
DIGITS = re.compile(r"[^0-9]+")
LABELERS = 5


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_ok(kind: str, said: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in said.split("."))
    if kind == "card":
        d = said.replace(" ", "").replace("-", "")
        return 14 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 10 <= len(DIGITS.sub("", said)) <= 15
    return True


def mails(text: str, wide: bool = False) -> list[tuple[int, int]]:
    """(start, end) of mail addresses, leftmost and without overlap, in time linear in the text: from each mark, the run
    of characters left of it is measured once, and so is the domain right of it.

    The base form is BASE's pattern. The wide one begins with a letter or digit and may have (at), (dot) and spaces.
    """
    out, low = [], 0
    for m in (WIDE_MARK if wide else MARK).finditer(text):
        at = m.start() - (wide and m.start() > low and text[m.start() - 1] == " ")
        start = low + len(text[low:at].rstrip(LOCAL))
        if wide:
            start = at - len(text[start:at].lstrip("._%+-"))
        d = (WIDE_DOMAIN if wide else DOMAIN).match(text, m.end()) if start < at else None
        low = d.end() if d else m.end()
        if d:
            out.append((start, low))
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), by start, then in the order of KINDS."""
    out = []
    digit = re.search("[0-9]", text)
    for k, kind in enumerate(KINDS):
        if "@" in text if kind == "email" else digit and (kind != "phone" or "+" in text):
            found = mails(text) if kind == "email" else [m.span() for m in BASE[kind].finditer(text)]
            out += [(a, k, kind, z) for a, z in found if base_ok(kind, text[a:z])]
    return [(a, kind, z) for a, _, kind, z in sorted(out)]


def votes(text: str, kind: str, a: int, z: int) -> tuple[int, ...]:
    """1 for, -1 against, 0 abstaining: pattern, checksum, gazetteer, context, shape."""
    said, d = text[a:z], DIGITS.sub("", text[a:z])
    m = BASE[kind].fullmatch(said)
    pattern = 1 if m and base_ok(kind, said) else -1
    if kind == "email":
        last = re.split(r"[^A-Za-z0-9]+", said)[-1].lower()
        check, known = 0, 1 if last in DOMAINS else -1
    elif kind == "ip":
        parts = [int(p) for p in re.split(r"[.,]", said)[:4] if len(p) < 5]
        check, known = (1 if len(parts) == 4 and max(parts) <= 255 else -1), (-1 if parts and parts[0] == 0 else 0)
    elif kind == "card":
        check, known = (1 if luhn(d) else -1), (1 if d.startswith(ISSUERS) else -1)
    else:
        check, known = (1 if 10 <= len(d) <= 15 else -1), (1 if said.startswith(("+", "00")) else 0)
    context = 1 if CUES[kind].search(text, max(0, a - 40), a) else 0
    glued = (a and (text[a - 1].isalnum() or text[a - 1] in "=._/")) or (z < len(text) and (text[z].isalnum() or text[z] in "=_/"))
    shape = -1 if glued or (len(d) > 6 and len(set(d)) < 3) else 1
    return pattern, check, known, context, shape


def candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int, str, bool]]:
    """(start, kind, end, votes, whether it is a base span): the base spans, and wide matches that overlap no base span
    and no earlier wide match."""
    out = [(a, k, z, ",".join(map(str, votes(text, k, a, z))), True) for a, k, z in base]
    if not re.search("[0-9@]|[(\\[]at[)\\]]", text):
        return out
    more = sorted((a, i, k, z) for i, k in enumerate(KINDS) for a, z in (mails(text, wide=True) if k == "email" else [m.span() for m in WIDE[k].finditer(text)]))
    taken, end = [(a, z) for a, _, z in base], -1
    j, reach = 0, -1
    for a, _, k, z in more:
        while j < len(taken) and taken[j][0] < z:
            reach = max(reach, taken[j][1])
            j += 1
        if a >= end and a >= reach:
            out.append((a, k, z, ",".join(map(str, votes(text, k, a, z))), False))
            end = z
    return out


def em(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> np.ndarray:
    """Posterior that a span is personal data, for each (kind, votes, count): naive Bayes over the labelers, by kind.

    Reliabilities start as mildly better than chance, with one pseudo-count a value, so that the classes keep their
    meaning and no probability is 0.
    """
    out = np.zeros(len(patterns))
    for kind in KINDS:
        rows = [i for i, p in enumerate(patterns) if p[0] == kind]
        if not rows:
            continue
        v = np.array([patterns[i][1] for i in rows]) + 1
        n = np.array([patterns[i][2] for i in rows], float)
        q = 1 / (1 + np.exp(-(v - 1).sum(1).astype(float)))
        for _ in range(rounds):
            prior = (q @ n + 1) / (n.sum() + 2)
            log = np.tile([[np.log(1 - prior)], [np.log(prior)]], (1, len(rows)))
            for j in range(v.shape[1]):
                for c, w in enumerate(((1 - q) * n, q * n)):
                    p = np.array([w[v[:, j] == x].sum() + 1 + 2 * ((x == 2) == (c == 1) and x != 1) for x in range(3)])
                    log[c] += np.log(p / p.sum())[v[:, j]]
            q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
        out[rows] = q
    return out


def fit_classifier(patterns: list[tuple[str, tuple[int, ...], int]], soft: np.ndarray, rounds: int = 400, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression on one-hot votes and kind, against the posteriors, each pattern weighted by its count."""
    x = np.array([features(k, v) for k, v, _ in patterns], float)
    n = np.array([c for *_, c in patterns], float)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, x.T @ (n * (soft - p)) - penalty * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def features(kind: str, v: tuple[int, ...]) -> list[int]:
    return [1, *[int(kind == k) for k in KINDS], *[int(x == y) for x in v for y in (-1, 1)]]


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, uid, base and cands (arrays of start, kind, end, votes, is_base) for each row of docs, as a written table."""
    kind = "doc_id long, base array<struct<start:int,kind:string,stop:int>>, cands array<struct<start:int,kind:string,stop:int,votes:string,is_base:boolean>>"
    one = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())])
    two = pa.struct([*one, pa.field("votes", pa.string()), pa.field("is_base", pa.bool_())])

    def run(batches):
        for batch in batches:
            base, cands = [], []
            for t in batch.column(1).to_pylist():
                b = base_spans(t or "")
                base.append([{"start": a, "kind": k, "stop": z} for a, k, z in b])
                cands.append([{"start": a, "kind": k, "stop": z, "votes": v, "is_base": f} for a, k, z, v, f in candidates(t or "", b)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(one)), pa.array(cands, pa.list_(two))], ["doc_id", "base", "cands"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), kind)


def fit(found: DataFrame, threshold: float = 0.5) -> list[str]:
    """The `kind|votes` that the classifier accepts, from the counts over all candidates of `found`."""
    c = found.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    rows = sorted((r["kind"], tuple(map(int, r["votes"].split(","))), r["n"]) for r in c.collect())  # 4 * 3**5 rows at most
    if not rows:
        return []
    w = fit_classifier(rows, em(rows))
    return [f"{k}|{','.join(map(str, v))}" for k, v, _ in rows if np.array(features(k, v)) @ w > np.log(threshold / (1 - threshold))]


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind, stop; code points, end exclusive) for each row of docs.

    spans holds every base span and the wide candidates the classifier accepts, by start, then in the order of KINDS.
    Null or empty text: empty arrays. Repeated rows each get theirs. Texts are read once; no text is shuffled.
    """
    found = saved(find_spans(docs))
    accepted = fit(found, threshold)
    bare = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["stop"].alias("stop"))
    key = lambda c: F.concat_ws("|", c["kind"], c["votes"])
    good = F.filter("cands", lambda c: ~c["is_base"] & key(c).isin(accepted)) if accepted else F.filter("cands", lambda c: F.lit(False))
    spans = F.concat("base", F.transform(good, bare))
    place = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), place[s["kind"]].alias("place"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return found.select("doc_id", "base", F.transform(spans, bare).alias("spans"))


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs with every span of its text replaced by [KIND]; the other columns are unchanged, null texts stay null.

    One pass counts the votes, a second rewrites texts where they stand, so that no text is shuffled. Of overlapping
    spans, the union is replaced under the kind of the first.
    """
    accepted = set(fit(saved(find_spans(docs)), threshold))
    names = docs.columns
    at = names.index("text")

    def clean(t: str) -> str:
        base = base_spans(t)
        spans = sorted((a, KINDS.index(k), k, z) for a, k, z, v, f in candidates(t, base) if f or f"{k}|{v}" in accepted)
        out, end = [], 0
        for a, _, k, z in spans:
            if a >= end:
                out += [t[end:a], f"[{k.upper()}]"]
            end = max(end, z)
        return "".join([*out, t[end:]])

    def run(batches):
        for batch in batches:
            texts = pa.array([t if t is None else clean(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(batch.columns)], names)

    return docs.mapInArrow(lean(run), docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """detect()'s rows as counts and digests: the form of the query."""
    say = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(say("base"), 256).alias("base_sha256"), say("spans").alias("spans"))


def base_digest(text: str) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, k, z in base_spans(text)).encode()).hexdigest()
