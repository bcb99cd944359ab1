"""Secret scans: fixed patterns, and a linear-chain conditional random field that tags further tokens."""

from __future__ import annotations

import heapq
import math
import random
import re
import string
import sys
from array import array
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import bounded_sample, sliced, table
from nearfold.scratch import written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs are the same as those of + with the short ones dropped
KEYS = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")

Span = tuple[int, int, int]  # start, kind as listed, end


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and non-overlapping per kind, by start and kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# Regions are what the field reads: the surroundings of long tokens with a digit, a symbol or a capital after a small letter, of
# values under names such as pwd, and of credentials in addresses. Everything else is outside by constraint.
INNER = frozenset(string.ascii_letters + string.digits + "+/_.=-")
TRIGGER = re.compile(r"[0-9+/_=-]|[a-z][A-Z]")
TAIL = re.compile(r"[A-Za-z0-9+/_.=-]+")
NAMES = ("pass", "pwd", "secret", "token", "auth", "cred", "bearer", "private", "signature", "session", "key")
NAMED = re.compile(r"(?:pass|pwd|secret|token|auth|cred|bearer|private|signature|session|key)[\w-]{0,24}[\"']?[ \t]{0,3}(?:=>|:=|[:=])", re.I)
ADDRESS = re.compile(r"://[^\s/:@]{1,64}:[^\s/@]{1,128}@")
KEYLIKE = re.compile(r"key|token|secret|pass|pwd|auth|cred|bearer|private|signature|session", re.I)
#: Words and numbers with what joins them, base64 with its padding, and all other marks one by one.
TOKEN = re.compile(r"\w(?:[\w+/.-]*[\w+/])?(?:(?<=[\w+/]{16})={1,2}(?![\w=]))?|\S")
BLANK = re.compile(r"\s")
LEAST, BEFORE, AFTER, CHUNK = 8, 40, 24, 200


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of long tokens that can be secret by themselves."""
    done = 0
    for m in TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] in INNER:
            start -= 1
        done = TAIL.match(text, m.start()).end()
        end = done
        while end > start and text[end - 1] in ".=-":  # marks at an end belong to the sentence
            end -= 1
        while start < end and text[start] in ".=-":
            start += 1
        if end - start >= LEAST:
            yield start, end


def regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of what the field reads, in order and apart. They begin and end between words, if one is near."""
    found = [((s, e + 8) for s, e in candidates(text))]
    low = text.lower()
    if any(x in low for x in NAMES):
        found.append((m.start(), m.end() + AFTER) for m in NAMED.finditer(text))
    if "://" in text and "@" in text:
        found.append(m.span() for m in ADDRESS.finditer(text))
    out: list[tuple[int, int]] = []
    for s, e in heapq.merge(*found):  # each comes in order
        a = max(0, s - BEFORE)
        if a and (blank := BLANK.search(text, a, s)):
            a = blank.end()
        blank = BLANK.search(text, min(e, len(text)), min(len(text), e + CHUNK))
        b = blank.start() if blank else min(len(text), e + CHUNK)
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Tokens:
    """(start, end) of the tokens of a region, eight bytes each: a region may be as long as its text."""

    def __init__(self, text: str, start: int, end: int):
        self.starts, self.ends = array("i"), array("i")
        for m in TOKEN.finditer(text, start, end):
            s, e = m.span()
            self.starts.append(s)
            self.ends.append(e)

    def __len__(self) -> int:
        return len(self.starts)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)


def tokens_of(text: str, start: int, end: int) -> Tokens:
    return Tokens(text, start, end)


def _bucket(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


def file_features(text: str) -> list[str]:
    """Of the document as a whole."""
    n = max(1, len(text))
    marks = (text.count("=") + text.count(": ")) * 1000 / n
    return [f"file=marks{_bucket(marks, 0.2, 2, 10)}", f"file=size{_bucket(n, 200, 2000, 20000)}"]


class _Shapes(dict):
    """token -> features of its letters alone, computed once per distinct token while the cache lasts. They are interned: most are alike."""

    def __missing__(self, token: str) -> list[str]:
        if len(self) > 200_000:
            self.clear()
        n = len(token)
        if n == 1:
            out = [f"mark={token}" if not token.isalnum() else "one"]
        else:
            classes = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in token]
            kinds = Counter(classes)
            turns = sum(x != y for x, y in zip(classes, classes[1:])) / n
            entropy = -sum(v / n * math.log2(v / n) for v in Counter(token).values())
            words = max(map(len, re.findall("[a-z]+", token)), default=0)
            out = [
                f"len{_bucket(n, 4, 8, 12, 16, 20, 24, 32, 40, 60)}", f"digits{_bucket(kinds['0'] / n, 0.01, 0.1, 0.3, 0.6, 0.99)}", f"turns{_bucket(turns, 0.1, 0.2, 0.35, 0.5)}",
                f"entropy{_bucket(entropy, 2, 2.5, 3, 3.5, 4, 4.5)}", "set=" + "".join(sorted(kinds)), f"shape={re.sub(r'(.)\1+', r'\1', ''.join(classes))[:6]}",
                f"turns{_bucket(turns, 0.2, 0.35)}entropy{_bucket(entropy, 3, 3.5, 4)}digits{_bucket(kinds['0'] / n, 0.01, 0.3)}len{_bucket(n, 12, 20, 32)}",
                "hex" if n >= 8 and all(c in "0123456789abcdefABCDEF" for c in token) else "nothex", f"begins={token[:4]}" if token[:4].isalpha() else f"begins={classes[0]}",
            ]
            if n <= 14 and token.isalpha():
                out.append("word=" + token.lower())
            if "." in token or "/" in token or "-" in token:
                out.append(f"parts{min(6, len(re.split('[./-]', token)))}" + ("word" if words > 4 else "noword"))
        out = [sys.intern(x) for x in out]
        if n <= 256:  # what is cached is bounded in bytes too
            self[token] = out
        return out


_shapes = _Shapes()


def chain_features(text: str, tokens: Tokens, file: list[str]) -> Iterator[list[str]]:
    """Features of each token of a region: its shape, its neighbours, the run of tokens without blanks it is in, the name it is under, and the file's."""
    starts, ends, n = tokens.starts, tokens.ends, len(tokens)
    word = lambda k: text[starts[k] : ends[k]]
    lows = deque(["", "", "", "", word(0).lower()[:12] if n else ""], 5)  # beginnings of the three words before, this one and the next
    first = last = -1  # of the run
    named, under = -99, ""  # where the last name was, and which
    chunk: list[str] = []
    for k in range(n):
        w, s = word(k), starts[k]
        lows.append(word(k + 1).lower()[:12] if k + 1 < n else "")
        if k > last:
            first = last = k
            while last + 1 < n and starts[last + 1] == ends[last]:
                last += 1
            end = ends[last]
            run = text[s : min(end, s + 160)]
            kinds = sum((any(c.islower() for c in run), any(c.isupper() for c in run), any(c.isdigit() for c in run), any(not c.isalnum() for c in run)))
            long = f"run{_bucket(len(run), 6, 10, 16, 24, 40)}kinds{kinds}"
            # the run's address and the mark of its user, found once for all its tokens; its last token that is an @
            address = text.find("://", s, end)
            user = text.find(":", address + 3, end) if address >= 0 else -1
            at = next((j for j in range(last, first, -1) if ends[j] - starts[j] == 1 and text[starts[j]] == "@"), -1) if text.find("@", s, end) >= 0 else -1
            chunk = [long, f"runof{_bucket(last - k, 1, 2, 4, 8)}"]
        gap = text[ends[k - 1] : s] if k else " "
        near = ["gap=" + ("none" if not gap else f"line{_bucket(len(w), 3, 9, 24)}" if gap in ("\n", "\r\n") else "lines" if "\n" in gap else "space"), *(f"before{d}={lows[3 - d]}" for d in (1, 2, 3)), f"after={lows[4]}"]
        if k - named <= 8:
            line = text.find("\n", ends[named], s) >= 0
            near += [f"under{_bucket(k - named, 2, 3, 4, 6)}" + "line" * line, f"under={under}{_bucket(k - named, 3, 5)}"]
            if not line and any(word(j) in ":=" for j in range(named + 1, k)):
                near.append(f"value{_bucket(k - named, 3, 4, 5)}" + ("long" if len(w) >= 6 else "short"))
        elif 0 <= address <= s - 3:
            near.append("address" + ("user" if 0 <= user < s else ""))
        if k and not gap:
            near.append(f"glue={lows[2] if len(lows[2]) == 1 else 'word'}{'word' if w[0].isalnum() else w[0]}")
        if at > k:
            near.append("beforeat")
        yield ["bias", *_shapes[w], *near, *chunk, *file]
        if (m := KEYLIKE.search(w)) and len(w) <= 40:
            named, under = k, m.group().lower()


class ChainField:
    """Linear-chain conditional random field over the labels outside, begin and inside of all tokens of a region; inside never follows outside,
    nor white space other than one line feed.

    What lies around a region is outside by constraint, so regions are independent and decoding each by Viterbi is exact for the whole text.
    """

    def __init__(self, names: list[str]):
        self.index = {x: k for k, x in enumerate(names)}
        self.weights = np.zeros((len(names), 3))
        self.moves = np.array([[0.0, 0.0, -1e9], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])

    def emissions(self, chain: Iterable[list[str]]) -> Iterator[list[float]]:
        for fs in chain:
            yield self.weights[[self.index[f] for f in fs if f in self.index]].sum(0).tolist()

    def viterbi(self, emitted: Iterable) -> list[int]:
        """Labels of a chain of emissions, of which it keeps only where each label came from, a byte each."""
        moves, back, rows = self.moves.tolist(), bytearray(), iter(emitted)
        best = [m + e for m, e in zip(moves[0], next(rows))]
        for row in rows:
            came = [max(range(3), key=lambda a, b=b: best[a] + moves[a][b]) for b in range(3)]
            back += bytes(came)
            best = [best[came[b]] + moves[came[b]][b] + row[b] for b in range(3)]
        labels = [max(range(3), key=lambda a: best[a] + moves[a][0])]
        for at in range(len(back) - 3, -1, -3):
            labels.append(back[at + labels[-1]])
        return labels[::-1]

    def fit(self, chains: list[list[list[str]]], labels: list[list[int]], epochs: int = 60, rate: float = 0.2, l2: float = 1e-3, most: int = 48) -> ChainField:
        """Adagrad on the likelihood, by forward and backward sums over all chains at once.

        Chains are cut where both sides are outside, into parts of about `most` tokens, and filled up with tokens that are outside for sure, which
        changes no likelihood.
        """
        parts = []
        for c, y in zip(chains, labels):
            at = 0
            while at < len(c):
                end = min(len(c), at + most)
                while end < len(c) and end < at + 2 * most and (y[end - 1] or y[end]):
                    end += 1
                parts.append((c[at:end], y[at:end]))
                at = end
        if not parts:
            return self
        n, rows = max(len(y) for _, y in parts), len(parts)
        truth, real = np.zeros((rows, n), np.int64), np.zeros((rows, n), bool)
        for r, (_, y) in enumerate(parts):
            truth[r, : len(y)], real[r, : len(y)] = y, True
        held = [[self.index[f] for f in fs if f in self.index] for c, _ in parts for fs in c]
        flat, sizes = np.array([f for x in held for f in x], np.int64), np.array([len(x) for x in held])
        token, where = np.repeat(np.arange(len(held)), sizes), np.flatnonzero(real.ravel())
        one_hot, total = np.eye(3)[truth], rows
        gw, gm = np.full_like(self.weights, 1e-8), np.full_like(self.moves, 1e-8)
        blanks = [self.index[x] for x in ("gap=space", "gap=lines") if x in self.index]
        self.weights[blanks, 2] = -1e3
        for _ in range(epochs):
            e = np.full((rows * n, 3), -1e9)
            e[:, 0] = 0.0
            e[where] = np.stack([np.bincount(token, self.weights[flat, k], minlength=len(held)) for k in range(3)], 1)
            e = e.reshape(rows, n, 3)
            forward, backward = np.zeros_like(e), np.zeros_like(e)
            forward[:, 0] = self.moves[0] + e[:, 0]
            for t in range(1, n):
                forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + self.moves, axis=1) + e[:, t]
            backward[:, -1] = self.moves[:, 0]
            for t in range(n - 2, -1, -1):
                backward[:, t] = np.logaddexp.reduce(self.moves + (backward[:, t + 1] + e[:, t + 1])[:, None, :], axis=2)
            z = np.logaddexp.reduce(forward[:, -1] + self.moves[:, 0], axis=1)
            off = np.exp(forward + backward - z[:, None, None]) - one_hot
            of_token = off.reshape(-1, 3)[where]
            dw = l2 * self.weights + np.stack([np.bincount(flat, of_token[token, k], minlength=len(self.weights)) for k in range(3)], 1) / total
            dm = np.zeros_like(self.moves)
            dm[0] += off[:, 0].sum(0) / total
            dm[:, 0] += off[:, -1].sum(0) / total
            for t in range(1, n):
                edge = np.exp(forward[:, t - 1, :, None] + self.moves + (backward[:, t] + e[:, t])[:, None, :] - z[:, None, None])
                dm += (edge.sum(0) - np.bincount(truth[:, t - 1] * 3 + truth[:, t], minlength=9).reshape(3, 3)) / total
            gw += dw * dw
            gm += dm * dm
            self.weights -= rate * dw / np.sqrt(gw)
            self.moves -= rate * dm / np.sqrt(gm)
            self.moves[0, 2] = -1e9
            self.weights[blanks, 2] = -1e3
        return self


def crf_spans(text: str, field: ChainField, base: list[Span]) -> list[Span]:
    """Spans that the field tags, without those that touch a base span."""
    parts = regions(text)
    if not parts:
        return []
    file, found = file_features(text), []
    for start, end in parts:
        tokens = tokens_of(text, start, end)
        if not tokens:
            continue
        spans: list[list[int]] = []
        for (s, e), y in zip(tokens, field.viterbi(field.emissions(chain_features(text, tokens, file)))):
            if y == 1:
                spans.append([s, e])
            elif y == 2:
                spans[-1][1] = e
        found += spans
    # both in order: one pass, with the furthest end of the base spans that begin before
    out, at, reach = [], 0, -1
    for s, e in found:
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s:
            out.append((s, 3, e))
    return out


def _made_up(n: int, rng: random.Random) -> list[tuple[str, list[tuple[int, int]]]]:
    """Short texts with secrets under names and of forms that the fixed patterns don't know, and with what only looks like them.

    Secrets may be several tokens: passwords with marks, addresses with credentials, blocks of lines.
    """
    letters, lower = string.ascii_letters + string.digits, string.ascii_lowercase
    words = ["the", "config", "for", "server", "uses", "value", "und", "para", "les", "user", "see", "run", "with", "login", "of", "die", "que", "note", "is", "set", "to", "our", "last", "week", "report"]
    pick = lambda chars, a, b: "".join(rng.choices(chars, k=rng.randint(a, b)))
    word = lambda: pick(lower, 3, 9)
    long = [
        lambda: pick(letters, 20, 48), lambda: pick(letters + "+/", 24, 64) + rng.choice(["", "=", "=="]), lambda: pick("0123456789ABCDEF", 32, 64),
        lambda: rng.choice(["ghp_", "sk-", "xoxb-", "glpat-", "pk_live_"]) + pick(letters, 20, 40), lambda: pick(letters + "-_", 10, 16) + "." + pick(letters + "-_", 20, 50) + "." + pick(letters + "-_", 20, 40),
    ]
    short = [
        lambda: pick(lower, 6, 12), lambda: pick(lower, 4, 8) + pick(string.digits, 1, 4), lambda: pick(letters + "!@#$%^&*?", 8, 16), lambda: word().title() + rng.choice("!@#$%&*") + pick(letters, 2, 6) + rng.choice("!?#$"),
        lambda: rng.choice("-_.").join(word() for _ in range(rng.randint(3, 5))), lambda: pick(letters, 6, 14), lambda: word() + rng.choice("@#$!") + pick(string.digits, 2, 4),
    ]
    named = ["auth", "credential", "credentials", "private_key", "client_secret", "bearer", "pwd", "access_key", "signature", "session_key", "signing_key", "user_pass", "mail_pwd", "pass", "auth_key"]
    plain = [
        lambda: f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.{rng.randint(1, 255)}", lambda: pick(string.digits, 8, 19), lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        lambda: "http://www." + pick(lower, 4, 12) + ".example/" + word() + "/" + str(rng.randint(1, 999)), lambda: "-".join(word() for _ in range(rng.randint(2, 4))),
        lambda: "".join(word().title() for _ in range(rng.randint(2, 4))), lambda: "_".join(word() for _ in range(rng.randint(2, 4))), lambda: word() + "." + word() + "@" + word() + ".example.com",
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))), lambda: "-".join(pick("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: "v" + ".".join(str(rng.randint(0, 300)) for _ in range(4)),
        lambda: word() + "." + word() + str(rng.randint(1, 999)), lambda: "+" + pick(string.digits, 9, 12), lambda: word() + "=" + str(rng.randint(1000, 9999)), lambda: word() + " " + word() + "! " + word() + "? (" + word() + ")",
        lambda: rng.choice(["key: ", "Key point: ", "author: ", "session: ", "passage: ", "authors = ", "password policy: ", "key = "]) + rng.choice(["see", "the", "none", "required", "it is", "Monday", "two"]) + " " + word(), lambda: "https://" + word() + ":" + str(rng.randint(80, 9999)) + "/" + word() + "@" + word(),
        lambda: "#" + word() + "_" + word() + " & " + word() + "-" + word() + "; " + word().title() + "'s", lambda: "$" + str(rng.randint(1, 999)) + "." + pick(string.digits, 2, 2) + " (" + str(rng.randint(1, 99)) + "%)",
    ]
    out = []
    for _ in range(n):
        parts, spans, at = [], [], 0

        def put(x: str, secret: bool = False) -> None:
            nonlocal at
            if secret:
                spans.append((at, at + len(x)))
            parts.append(x)
            at += len(x)

        for _ in range(rng.randint(1, 4)):
            quote = ""
            put(" ".join(rng.choices(words, k=rng.randint(1, 5))) + rng.choice([" ", "\n", ": ", " ("]))
            form = rng.random()
            if form < 0.2:
                if rng.random() < 0.8:
                    put(rng.choice(named) + (opened := rng.choice([" = ", "=", ": ", '": "', " ", " => ", " = '"])))
                    quote = opened[-1].strip("= :>")
                put(rng.choice(long)(), True)
            elif form < 0.36:
                put(rng.choice(named) + (opened := rng.choice([" = ", "=", ": ", '": "', " = '", " := ", '="'])))
                quote = opened[-1].strip("= :>")
                put(rng.choice(short)(), True)
            elif form < 0.43:
                put(rng.choice(["https", "ftp", "mysql", "redis", "amqp"]) + "://" + word() + ":")
                put(rng.choice(short[1:4] + short[5:])().replace("@", "").replace("/", ""), True)
                put("@" + word() + "." + word() + rng.choice(["", ":" + str(rng.randint(1000, 9999)), "/" + word()]))
            elif form < 0.5:
                put(rng.choice(["Private key:", "-----BEGIN PRIVATE KEY-----", "-----BEGIN EC PRIVATE KEY-----", "private_key ="]) + "\n")
                wide = rng.choice([32, 48, 64, 76])
                put("\n".join(pick(letters + "+/", wide, wide) for _ in range(rng.randint(1, 4))) + "\n" + pick(letters + "+/", 9, wide - 1) + rng.choice(["", "=", "=="]), True)
                put(rng.choice(["\n-----END PRIVATE KEY-----", "\n", "\n-----END EC PRIVATE KEY-----"]))
            else:
                if rng.random() < 0.3:
                    put(rng.choice(["id", "date", "host", "path", "name", "version", "url"]) + rng.choice([" = ", "=", ": "]))
                put(rng.choice(plain)())
            put(quote + rng.choice([" ", "\n", ", ", "; ", ". ", "\n\n"]))
        out.append(("".join(parts), spans))
    return out


def _training(texts: list[str], made_up: int, seed: int) -> tuple[list, list]:
    """Chains and labels: of the texts, what the fixed patterns hold is secret and all else is not; of made-up ones it is known."""
    known = []
    for text in texts:
        secret = []
        for s, k, e in base_spans(text):
            secret.append((ASSIGN.match(text, s).start(2) if k == 0 else s, e))
        known.append((text, sorted(secret)))
    chains, labels = [], []
    for text, secret in known + _made_up(made_up, random.Random(seed)):
        file, at = file_features(text), 0
        for start, end in regions(text):
            tokens, y, last = tokens_of(text, start, end), [], None
            for s, e in tokens:
                while at < len(secret) and secret[at][1] <= s:
                    at += 1
                hit = at if at < len(secret) and secret[at][0] < e and s < secret[at][1] else None
                y.append(0 if hit is None else 2 if hit == last else 1)
                last = hit
            if tokens:
                chains.append(list(chain_features(text, tokens, file)))
                labels.append(y)
    return chains, labels


def learn(docs: DataFrame, sample: int = 400, made_up: int = 2000, most_chars: int = 20_000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> ChainField:
    """A field learned from at most `sample` documents that a fixed pattern hits and as many others, taken by hash.

    The fixed patterns label them; made-up texts add names and forms of secrets beyond those. Documents longer than
    most_chars aren't sampled (they are scanned whole), so what reaches the driver is bounded.
    """
    mine = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text").between(1, most_chars))
    hit = F.col("text").rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}") | F.col("text").rlike("[0-9a-f]{24}")
    marked = written(mine.select("doc_id", hit.alias("hit")), "pattern_hits")
    chosen = [bounded_sample(marked.filter(F.col("hit") == h), sample).select("doc_id") for h in (True, False)]
    ids = F.broadcast(written(chosen[0].unionByName(chosen[1]).distinct(), "chosen"))
    # ids that repeat bring further texts: of those too the same ones are taken however the table is partitioned
    texts = sorted({r.text for r in mine.join(ids, "doc_id").select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(4 * sample).collect()})
    chains, labels = _training(texts, made_up, seed)
    seen = Counter(f for c in chains for fs in c for f in set(fs))
    return ChainField(sorted(f for f, n in seen.items() if n >= 3)).fit(chains, labels)


def find_secrets(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans): kind, start and end, exclusive, in code points, of all secrets of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for part in sliced(batches, "text"):
            rows = []
            for text in part.column(1).to_pylist():
                base = base_spans(text or "")
                spans = sorted(base + crf_spans(text or "", field, base))
                rows.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.record_batch([part.column(0), pa.array(rows, kind)], ["id", "spans"])

    return (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(run, "id bigint, spans array<struct<kind:string,start:int,end:int>>")
        .withColumnRenamed("id", id_col)
    )


def redact(docs: DataFrame, field: ChainField, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every secret span of the text replaced; spans that touch are replaced as one."""
    kept, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, text_col):
            at = names.index(text_col)
            texts = []
            for text in part.column(at).to_pylist():
                base = base_spans(text or "")
                out, done = [], 0
                for s, _, e in sorted(base + crf_spans(text or "", field, base)):
                    if s >= done:
                        out += [text[done:s], mask]
                    done = max(done, e)
                texts.append("".join(out) + text[done:] if out else text)
            yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return docs.mapInArrow(run, kept)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`: counts and digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = find_secrets(docs, learn(docs))
    tell = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [of(k) for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(tell(base), 256).alias("base_sha256"), tell(F.col("spans")).alias("spans"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced, n_chars as it is then. Null texts stay null and empty ones empty; rows that repeat are treated alike."""
    clean = redact(docs, learn(docs))
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)
