"""Secret scan: candidates by their form, and a random forest that takes out the false ones.

A candidate is a run of at least 8 characters of ``A-Za-z0-9_-/+=.~`` that is 16 long or longer and has a digit, or that is assigned: it follows
``=`` or ``:``, quotes and spaces aside, and has a digit or is 12 long or longer. The forest judges it by its length, the classes of its
characters and their transitions, how much of it dictionary words cover, the path (the document's source), and the words before and
after it. It is trained on labelled findings; ``findings`` makes a set from the published forms of keys and of things that look like them.

Defined cases. A null or empty text has no candidates; a null source is an empty path. Repeated rows yield equal rows, and
equal candidates each their own. A null doc_id is carried along. Candidates of any length are judged whole, texts are
searched whole. An empty table gives an empty result; labels of one kind only give a forest that always says so. Extra columns are not read.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cairn.llm.common import pieces
from cairn.llm.textkernel import as_bytes

AROUND = 48  #: bytes before and after a candidate
TREES, DEPTH, LEAF = 40, 10, 3
THRESHOLD = 0.5
_run = np.zeros(256, bool)
_run[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-/+=.~"]] = True
_digit = np.zeros(256, bool)
_digit[48:58] = True
DICTIONARY = """access account address admin agent alert alpha android apache apple application archive array asset author backup banana
base beta block board book branch build bundle button cache card center change channel check class client cloud code color column
commit common config connect console content control cookie count custom data database date debug default delta demo deploy design
detail device digest dist document domain download dummy editor element email enable engine entry error event example export
external fake field file filter first font form frame framework function group handle header hello here home host icon image import
index info input insert install integer internal item java label large last layout level library license light line link list local
lock login main manager master media member menu message method mobile mock model module monday name network node note number
object office offset online option order output package page panel parent password path pattern person phone photo placeholder
player point policy port post preview price private process product profile project property public query random range record
release remote replace report request reset resource response result role root route sample schema screen script search second secret
section select server service session setting shared simple size social software source stage start state static status storage store
stream string style submit support system table task team temp template test text theme thread ticket time title today token tool track
transfer type unit update upload user value vendor version video view visit web week widget window word work world write year your""".split()
_SECRET = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "credential", "private", "signing", "client_key")
_DIGEST = ("sha", "md5", "commit", "checksum", "digest", "uuid", "guid", "revision", "integrity", "etag", "hash", "version", "build", "order", "invoice", "trace", "request", "card", "phone", "serial")
_EMPTY = ("example", "sample", "dummy", "placeholder", "fake", "your", "changeme", "redacted", "todo", "xxxx", "mock")
_PATH = ("test", "example", "mock", "fixture", "sample", "doc", "lock", "vendor", "node_modules", ".min.", "readme")


def candidates(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str], list[str], list[str]]:
    """Text, first byte in it, first character in it, length; and what stands there, before and after."""
    flat, off = as_bytes(pc.fill_null(texts, ""))
    n = len(flat)
    run = _run[flat]
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:], after[:n] = run, run
    before[off] = False
    shifted = after[1:].copy()
    shifted[off[off > 0] - 1] = False
    start, end = np.flatnonzero(run & ~before[:n]), np.flatnonzero(run & ~shifted) + 1
    long = end - start >= 8
    start, end = start[long], end[long]
    digits = np.r_[0, np.cumsum(_digit[flat])]
    has = digits[end] > digits[start]
    size = end - start
    maybe = has | (size >= 12)
    start, end, has, size = start[maybe], end[maybe], has[maybe], size[maybe]
    row = np.searchsorted(off, start, "right") - 1
    data = flat.tobytes()
    keep = []
    for i, (a, b, lo, yes, s) in enumerate(zip(start.tolist(), end.tolist(), off[row].tolist(), has.tolist(), size.tolist())):
        lead = data[max(lo, a - 4) : a].rstrip(b" \"'")
        inside = data[a:b].split(b"=", 1)
        if (yes and s >= 16) or lead.endswith((b"=", b":")) or (len(inside) == 2 and len(inside[1]) >= 8):
            keep.append(i)
    keep = np.array(keep, np.int64)
    start, end, row = start[keep], end[keep], row[keep]
    chars = np.r_[0, np.cumsum((flat & 0xC0) != 0x80)]
    hi = off[row + 1]
    take = lambda a, b: [data[x:y].decode("utf-8", "replace") for x, y in zip(a.tolist(), b.tolist())]
    return row, start - off[row], chars[start] - chars[off[row]], end - start, take(start, end), take(np.maximum(off[row], start - AROUND), start), take(end, np.minimum(hi, end + AROUND))


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _moves() -> np.ndarray:
    """Log-probabilities of letter pairs in dictionary words."""
    n = np.full((27, 27), 0.5)
    for w in DICTIONARY:
        for a, b in zip("`" + w, w + "`"):
            n[ord(a) - 96, ord(b) - 96] += 1
    return np.log(n / n.sum(1, keepdims=True))


_MOVES = _moves()
_WORDS = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) >= 4), key=len, reverse=True)))
FEATURES = ["length", "digits", "lower", "upper", "signs", "entropy", "transitions", "class_changes", "repeats", "dictionary", "hex", "digits_only", "digest_length", "uuid", "known_prefix",
            "path", "secret_before", "digest_before", "empty_near", "assigned", "quoted", "secret_inside", "slashes_dots"]


def features(text: str, before: str, after: str, path: str) -> list[float]:
    n = len(text)
    kinds = [_class(c) for c in text]
    share = [kinds.count(k) / n for k in range(4)]
    counts = [text.count(c) for c in set(text)]
    low, around = text.lower(), before.lower()
    steps = [_MOVES[ord(a) - 96, ord(b) - 96] for a, b in zip(low, low[1:]) if "a" <= a <= "z" and "a" <= b <= "z"]
    near = around[-32:]
    return [
        float(n), *share,
        -sum(c / n * math.log2(c / n) for c in counts),
        sum(steps) / len(steps) if steps else -6.0,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a == b for a, b in zip(text, text[1:])) / n,
        sum(len(m) for m in _WORDS.findall(low)) / n,
        float(all(c in "0123456789abcdef" for c in low)),
        share[0], float(n in (32, 40, 64, 128)),
        float(bool(re.fullmatch(r"[0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12}", low))),
        float(bool(re.match(r"AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live|rk_live|AIza|eyJ|glpat-|SG\.", text))),
        float(any(w in path.lower() for w in _PATH)),
        float(any(w in near for w in _SECRET)), float(any(w in near for w in _DIGEST)),
        float(any(w in around or w in low for w in _EMPTY)),
        float(before.rstrip(" \"'")[-1:] in ("=", ":")), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float(any(w in low for w in _SECRET)), sum(c in "/.~" for c in text) / n,
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), limit, left child, right child, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, limit, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                go = np.flatnonzero(feature[at] >= 0)
                if not len(go):
                    break
                here = at[go]
                at[go] = np.where(x[go, feature[here]] <= limit[here], left[here], right[here])
            out += value[at]
        return out / max(1, len(self.trees))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple:
    feature, limit, left, right, value = [], [], [], [], []
    some = max(1, int(math.sqrt(x.shape[1])))

    def grow(rows: np.ndarray, depth: int) -> int:
        me, p = len(feature), float(y[rows].mean())
        for col, v in ((feature, -1), (limit, 0.0), (left, 0), (right, 0), (value, p)):
            col.append(v)
        if depth == DEPTH or p in (0.0, 1.0) or len(rows) < 2 * LEAF:
            return me
        best = (p * (1 - p) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], some, replace=False):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, ones = x[order, f], np.cumsum(y[order])
            i = np.arange(1, len(order))
            total = ones[-1]
            a, b = ones[:-1] / i, (total - ones[:-1]) / (len(order) - i)
            loss = np.where((v[1:] > v[:-1]) & (i >= LEAF) & (len(order) - i >= LEAF), a * (1 - a) * i + b * (1 - b) * (len(order) - i), np.inf)
            k = int(loss.argmin())
            if loss[k] < best[0]:
                best = (float(loss[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] >= 0:
            feature[me], limit[me] = best[1], best[2]
            low = x[rows, best[1]] <= best[2]
            left[me] = grow(rows[low], depth + 1)
            right[me] = grow(rows[~low], depth + 1)
        return me

    grow(rng.integers(0, len(y), len(y)), 0)
    return tuple(np.array(c) for c in (feature, limit, left, right, value))


def train(rows: list[tuple[str, str, str, str, int]], trees: int = TREES, seed: int = 3) -> Forest:
    """rows: candidate, text before, text after, path, 1 for a secret and 0 for a false one."""
    if not rows:
        raise ValueError("there are no labelled findings")
    x, y = np.array([features(*r[:4]) for r in rows]), np.array([r[4] for r in rows], float)
    rng = np.random.default_rng(seed)
    return Forest([_tree(x, y, rng) for _ in range(trees)])


def findings(n: int = 3000, seed: int = 1) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings, half of them secrets, made from the published forms of keys, digests and placeholders."""
    r = random.Random(seed)
    hexa, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    of = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    prose = lambda k: " ".join("".join(r.choice("thaeronisdl") for _ in range(r.randint(2, 8))) if r.random() < 0.7 else r.choice(DICTIONARY) for _ in range(k))
    word = lambda: r.choice(DICTIONARY)
    secret = lambda: r.choice(["token", "secret", "password", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "private_key", "Authorization: Bearer", "passwd", "SECRET_KEY", "credentials"])
    digest = lambda: r.choice(["sha", "sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "revision", "integrity", "etag", "hash", "trace id", "build"])
    assign = lambda k: r.choice([f'{k} = "', f"{k}: '", f"{k}=", f'"{k}": "', f"{k}: ", f'{k}="'])
    real = [
        lambda: (of(hexa, r.choice([32, 40, 40, 64])), assign(secret())),
        lambda: (of(alnum, r.randint(20, 48)), assign(secret())),
        lambda: (of(alnum + "+/", 40), assign(secret())),
        lambda: ("AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), r.choice([assign(secret()), "id "])),
        lambda: (r.choice(["ghp_", "gho_", "glpat-", "sk_live_", "xoxb-", "AIza"]) + of(alnum, r.randint(24, 36)), r.choice([assign(secret()), assign(word()), ""])),
        lambda: ("eyJ" + of(alnum, 30) + "." + of(alnum, 60) + "." + of(alnum + "-_", 43), assign(secret())),
        lambda: (of(alnum + "_-", r.randint(10, 18)) + of("0123456789", 2), assign(secret())),
    ]
    false = [
        lambda: (of(hexa, r.choice([32, 40, 64])), r.choice([f"{digest()} ", assign(digest())])),
        lambda: (of(hexa, r.choice([32, 40, 64])), assign(word())),
        lambda: ("-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), assign(r.choice([digest(), word(), "id"]))),
        lambda: (of("0123456789", r.choice([13, 14, 15, 16, 19])), r.choice(["", "number ", "card ", assign(word())])),
        lambda: (f"{r.choice(['your', 'my', 'example', 'test', 'sample'])}{r.choice('-_')}{word()}{r.choice('-_')}{word()}{r.choice('-_')}{r.randint(1, 9999)}", assign(secret())),
        lambda: (of("xX*", 1) * r.randint(8, 30) + str(r.randint(0, 9999)), assign(secret())),
        lambda: ("/".join(word() for _ in range(r.randint(2, 5))) + f"/{r.randint(1, 99999)}.html", r.choice(["path ", "href=\"", ""])),
        lambda: ("_".join(word() for _ in range(r.randint(3, 5))) + f"_v{r.randint(1, 20)}", r.choice(["", assign(word())])),
        lambda: (f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(100, 255)}", "from "),
        lambda: (f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}", r.choice(["at ", assign("date")])),
        lambda: ("sha512-" + of(alnum + "+/", 86) + "==", assign("integrity")),
        lambda: (word().upper() + "_" + word().upper() + of("0123456789", 4), assign(r.choice([secret(), word()]))),
        lambda: (f"{r.randint(1, 40)}@mail{r.randint(0, 9)}.example.com".replace("@", "."), ""),
        lambda: ("".join(r.choice(["th", "er", "on", "an", "re", "ti", "es", "in"]) for _ in range(r.randint(7, 14))) + str(r.randint(1, 9)), ""),
    ]
    paths = ["", "app/config.py", "deploy/settings.yaml", "src/main.go", "tests/test_auth.py", "docs/readme.md", "package-lock.json", "web/site.min.js", "crawl", "forum"]
    out = []
    for i in range(n):
        text, lead = r.choice(real if i % 2 else false)()
        before = (prose(r.randint(0, 8)) + " " + lead)[-AROUND:]
        after = ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + r.choice([" ", "\n", ", ", ""]) + prose(r.randint(0, 6))
        out.append((text, before, after[:AROUND], r.choice(paths), i % 2))
    return out


def scan(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, length, score, is_secret): every candidate, from its first character on, and what the forest says."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                row, _, char, size, text, before, after = candidates(part.column("text"))
                if not len(row):
                    continue
                path = [s or "" for s in part.column("source").take(pa.array(row)).to_pylist()]
                score = shared.value.score(np.array([features(*r) for r in zip(text, before, after, path)]))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").take(pa.array(row)), "start": pa.array(char.astype(np.int64)), "length": pa.array(size.astype(np.int64)), "score": pa.array(score), "is_secret": pa.array(score >= threshold)})

    return docs.select("doc_id", "text", "source").mapInArrow(run, "doc_id bigint, start bigint, length bigint, score double, is_secret boolean")
