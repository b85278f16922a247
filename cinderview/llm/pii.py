"""Personal data: four certain patterns, and a semi-Markov conditional random field.

The patterns find spans that hold by rule. The model looks at islands, runs of words
with digits or an at sign, and scores every candidate segment of an island, up to
``LONGEST`` atoms, by features of the whole segment (digit groups, check sum, marks,
what stands around it). An atom is a run of digits, a word with the words that dots or
hyphens join to it, or any other character. One dynamic program over segment ends and
types chooses boundaries and types together; it is linear in the island's length since
an entity is bounded. Features come from prefix sums for ``STEP`` ends at a time and two
small numbers for each end and type are kept to walk back, so a text of many megabytes
that is one island takes some 30 bytes a character. Text outside islands never holds
an entity, so most of a corpus costs one scan.

The model is trained by exact likelihood gradients on a bounded sample of islands
labelled by the patterns, drawn by hash from all islands of the drawn documents; an
island over ``PART_CHARS`` is drawn in parts of that length, cut at white space if it
has any. Each is also shown in weaker spellings that the patterns
miss (no plus sign, other groups and separators, an at sign in words), with the same labels, and
with ordinary figures (dates, amounts, times) in their place, without labels.
"""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import drawn, map_texts, span_order, span_text, texts

# Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone")

# The certain patterns. No start within a run of digits can succeed where the run's own start fails.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Bounds of an entity, in atoms and in characters on either side of its digit or at sign.
LONGEST = 16
ISLAND_CHARS = 256
PART_CHARS = 256
STEP = 4096
TRAIN_DOCS = 40_000
TRAIN_TEXTS = 4000
TRAIN_ISLANDS = 600
EPOCHS = 6
TYPES = ("other", *KINDS)
ATOM = re.compile(r"[A-Za-z]+(?:[.-][A-Za-z]+)*|[0-9]+|[^A-Za-z0-9]")
TRIGGER = re.compile("[0-9@]|[(\\[](?:at|AT)[)\\]]")
NEAR = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "addr"),
    "card": ("card", "visa", "iban", "pay", "credit"),
    "phone": ("tel", "phone", "call", "fax", "mobile"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text):
    """Leftmost matches: the local part is the whole run of its letters before an at sign."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_LETTERS:
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
            last = found.end()
        # Letters behind this at sign are looked at once more at most.
        at = text.find("@", max(at + 1, last))
        last = max(last, start)
    return out


def certain_spans(text):
    """``[(kind, start, end)]`` of the four patterns, in order."""
    spans = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 3 or (len(p) == 3 and int(p) <= 255) for p in parts):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            spans.append(("phone", *m.span()))
    spans.sort(key=span_order(KINDS))
    return spans


def islands(text):
    """``(start, end)`` of runs of words with digits or at signs, joined over single blanks of a line."""
    out, end = [], 0
    for m in TRIGGER.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and m.start() - start < ISLAND_CHARS and not text[start - 1].isspace():
            start -= 1
        if m[0][0] in "([" and start > end and text[start - 1] == " ":
            # The word before an at sign in words.
            start -= 1
            while start > end and m.start() - start < ISLAND_CHARS and not text[start - 1].isspace():
                start -= 1
        new = m.end()
        while new < len(text) and new - m.end() < ISLAND_CHARS and not text[new].isspace():
            new += 1
        if m[0][0] in "([" and new < len(text) - 1 and text[new] == " ":
            new += 1
            while new < len(text) and new - m.end() < ISLAND_CHARS and not text[new].isspace():
                new += 1
        if out and start - out[-1][1] <= 1 and "\n" not in text[out[-1][1] : start]:
            out[-1] = (out[-1][0], new)
        else:
            out.append((start, new))
        end = new
    return out


N_FEATURES = 40


def before_each(values):
    """Sum of the values before each place, and before the end."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


class Island:
    """Atoms of an island, and the features of its segments of at most ``longest`` atoms."""

    def __init__(self, text, start, end, longest=LONGEST):
        self.longest = longest
        self.ends = np.fromiter((m.end() for m in ATOM.finditer(text, start, end)), np.int64)
        self.starts = np.append(start, self.ends[:-1])
        self.n = n = len(self.ends)
        near = text[max(0, start - 24) : start].lower()
        self.near = [36 + k for k, kind in enumerate(KINDS) if any(word in near for word in NEAR[kind])]

        # One character on either side of the island, blanks at the text's ends.
        around = (text[start - 1] if start else " ") + text[start:end] + (text[end] if end < len(text) else " ")
        codes = np.frombuffer(around.encode("utf-32-le", "surrogatepass"), "<u4")
        kinds, code = np.unique(codes, return_inverse=True)
        of = lambda rule: np.array([rule(chr(c)) for c in kinds.tolist()], bool)[code]
        alnum, alpha, space = of(str.isalnum), of(str.isalpha), of(str.isspace)
        digit = (codes >= 48) & (codes <= 57)
        # Sums by characters, at the atoms' bounds (``code`` 1 is the island's first).
        bounds = np.append(self.starts, end) - start + 1
        first, last = bounds[:-1], bounds[1:] - 1
        at = lambda values: before_each(values)[bounds]
        self.digits, self.letters = at(digit), at(alpha)
        self.dots, self.at_signs = at(codes == 46), at(codes == 64)
        self.opened, self.closed = at(codes == 40), at(codes == 41)
        side = lambda c: np.where(space[c], 0, np.where(alnum[c], 1, 2))
        self.before, self.after = side(bounds[:-1] - 1), side(bounds[1:])
        self.open_edge = alnum[first] | (codes[first] == 43) | (codes[first] == 40)
        self.closed_edge = alnum[last]
        self.plus = codes[first] == 43
        self.blank = space[first]
        # Letters behind the last dot or hyphen of an atom that is a word.
        other = np.where(alpha, 0, np.arange(len(codes)))
        label = last - np.maximum.accumulate(other)[last]
        self.domain = (~digit[first]) & alnum[last] & (label >= 2) & (label <= 6)
        # An at sign in words: its first bracket.
        bracket = np.isin(codes[first], (40, 91))
        word = np.zeros(n, bool)
        for k in np.flatnonzero(bracket[: max(n - 2, 0)]).tolist():
            word[k] = text[self.starts[k] : self.ends[k + 2]].lower() in ("(at)", "[at]")
        self.at_words = before_each(word)
        # Digit groups, by their order.
        group = digit[first]
        self.groups = before_each(group)
        sizes = (self.ends - self.starts)[group]
        self.group_sizes = np.append(sizes, [0, 0])
        values = np.zeros(len(sizes), np.int64)
        for k in range(3):
            short = sizes > k
            values[short] = values[short] * 10 + codes[first[group][short] + k] - 48
        self.no_octet = before_each((sizes > 3) | (values > 255))
        self.changes = before_each(np.append(False, sizes[1:] != sizes[:-1])[: len(sizes)])
        # Check sums with the even or the odd digits doubled, modulo 10.
        own = codes[digit].astype(np.int64) - 48
        double = np.where(own > 4, 2 * own - 9, 2 * own)
        odd = np.arange(len(own)) % 2 == 1
        self.first_digit = int(digit[0])
        self.check = [before_each(np.where(odd, double, own)), before_each(np.where(odd, own, double))]
        # Where each mark stands next, for the number of different ones.
        mark = ~alnum[first]
        self.next_mark = np.full(n, n + longest + 1)
        places = np.flatnonzero(mark)
        order = np.argsort(codes[first[places]], kind="stable")
        same = codes[first[places[order]]]
        again = np.flatnonzero(same[1:] == same[:-1])
        self.next_mark[places[order[again]]] = places[order[again + 1]]
        self.mark = mark

    def features(self, low, high):
        """Features of the segments that end at the atoms' bounds ``low + 1 .. high``, and which segments there are.

        By end and by length from 1 to ``longest``.
        """
        j = np.arange(low + 1, high + 1)[:, None]
        length = np.arange(1, self.longest + 1)[None]
        there = j - length >= 0
        i = np.maximum(j - length, 0)
        there &= (length == 1) | ~(self.blank[i] | self.blank[j - 1])
        out = np.zeros((*i.shape, N_FEATURES), np.float32)
        span = lambda sums: sums[j] - sums[i]
        digits, letters, dots, at_signs = span(self.digits), span(self.letters), span(self.dots), span(self.at_signs)
        groups, none = span(self.groups), letters == 0
        out[..., 0] = 1
        out[..., 1] = length > 1
        out[..., 2] = ~(self.open_edge[i] & self.closed_edge[j - 1])
        rows, columns = np.indices(i.shape, sparse=True)
        out[rows, columns, 3 + self.before[i]] = 1
        out[rows, columns, np.broadcast_to(6 + self.after[j - 1], i.shape)] = 1
        out[rows, columns, 9 + np.minimum(digits, 20) // 2] = 1  # 9 .. 19
        out[..., 20] = (at_signs == 1) & (letters > 0)
        out[..., 21] = (at_signs > 0) & (out[..., 20] == 0)
        out[..., 22] = (length > 2) & (self.at_words[np.maximum(j - 2, i)] > self.at_words[i])
        out[..., 23] = (dots > 0) & self.domain[j - 1]
        octets = (groups == 4) & none & (self.no_octet[self.groups[j]] == self.no_octet[self.groups[i]])
        out[..., 24] = octets & (dots == 3)
        out[..., 25] = octets & (dots != 3)
        card = (digits >= 12) & (digits <= 19) & none
        first, last = self.digits[i] - self.first_digit, self.digits[j] - self.first_digit
        # The last digit is never doubled.
        total = np.where((last - 1) % 2 == 0, self.check[0][last] - self.check[0][first], self.check[1][last] - self.check[1][first])
        out[..., 26] = card & (total % 10 == 0)
        out[..., 27] = card & (total % 10 != 0)
        first, last = self.groups[i], self.groups[j]
        even = self.changes[last] == self.changes[np.minimum(first + 1, last)]
        out[..., 28] = card & (groups > 1) & even
        out[..., 29] = self.plus[i]
        out[..., 30] = (span(self.opened) > 0) & (span(self.closed) > 0)
        out[..., 31] = (groups > 1) & (self.group_sizes[last - 1] == 4) & (self.group_sizes[last - 2] == 3)
        out[..., 32] = groups > 2
        out[..., 33] = letters > 0
        # A segment has the marks of the one without its first atom, and that atom's if it does not come again.
        marks = np.zeros(i.shape, np.int64)
        new = self.mark[i] & (self.next_mark[i] >= j)
        marks = np.cumsum(new, axis=1)
        out[..., 34] = marks > 3
        out[..., 35] = (digits >= 7) & (digits <= 15) & none
        out[..., self.near] = 1
        return out, there

    def scores(self, weights, low=0, high=None):
        """Scores by end, length and type; -inf where there is no such segment."""
        features, there = self.features(low, self.n if high is None else high)
        out = features @ weights
        out[~there] = -np.inf
        # Other text is taken atom by atom.
        out[:, 1:, 0] = -np.inf
        return out


def log_sum(x, axis=None):
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top
    return out.squeeze() if axis is None else out.squeeze(axis)


def forward(scores, moves):
    """Log sums over all segmentations of each prefix, by the type of its last segment, and of the next."""
    n, longest, k = scores.shape
    alpha, come = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
    alpha[0, 0] = 0.0
    come[0] = log_sum(alpha[0][:, None] + moves, axis=0)
    for j in range(1, n + 1):
        most = min(j, longest)
        alpha[j] = log_sum(come[j - most : j][::-1] + scores[j - 1, :most], axis=0)
        come[j] = log_sum(alpha[j][:, None] + moves, axis=0)
    return alpha, come


def gradient(island, gold, weights, moves):
    """Gradient of the log likelihood of ``gold``, the list of ``(end, length, type)``."""
    features, _ = island.features(0, island.n)
    scores = island.scores(weights)
    alpha, come = forward(scores, moves)
    n, longest, k = scores.shape
    total = log_sum(alpha[n])
    beta = np.full((n + 1, k), -np.inf)
    beta[n] = 0.0
    expected, grad_moves = np.zeros(scores.shape), np.zeros_like(moves)
    for i in range(n - 1, -1, -1):
        lengths = np.arange(min(longest, n - i))
        ahead = scores[i + lengths, lengths] + beta[i + lengths + 1]
        expected[i + lengths, lengths] = np.exp(come[i] + ahead - total)
        on = log_sum(ahead, axis=0)
        grad_moves -= np.exp(alpha[i][:, None] + moves + on - total)
        beta[i] = log_sum(moves + on, axis=1)
    last = 0
    for j, length, t in gold:
        expected[j - 1, length - 1, t] -= 1.0
        grad_moves[last, t] += 1.0
        last = t
    return -np.tensordot(features, expected, axes=((0, 1), (0, 1))), grad_moves


def best_segments(island, weights, moves):
    """The most likely segmentation: ``[(kind, start, end)]`` of its entities."""
    n, longest, k = island.n, island.longest, len(TYPES)
    types = np.arange(k)
    # Of each end and type: the length of its last segment, and the type before a segment that begins there.
    lengths, types_before = np.zeros((n + 1, k), np.uint8), np.zeros((n + 1, k), np.uint8)
    best = np.full(k, -np.inf)
    best[0] = 0.0
    # Best scores up to the last ends, newest first, by the type that follows.
    come = np.full((longest, k), -np.inf)
    for low in range(0, n, STEP):
        scores = island.scores(weights, low, min(n, low + STEP))
        for j in range(low, min(n, low + STEP)):
            paths = best[:, None] + moves
            before = paths.argmax(axis=0)
            types_before[j] = before
            come[1:] = come[:-1]
            come[0] = paths[before, types]
            paths = come + scores[j - low]
            choice = paths.argmax(axis=0)
            lengths[j + 1] = choice + 1
            best = paths[choice, types]
    out, j, t = [], n, int(best.argmax())
    while j > 0:
        i = j - int(lengths[j, t])
        if t:
            out.append((TYPES[t], int(island.starts[i]), int(island.ends[j - 1])))
        j, t = i, int(types_before[i, t])
    return out[::-1]


def gold_segments(island, spans):
    """``(end, length, type)`` of an island labelled by ``spans``; None if a span does not end on atoms or is too long."""
    first = {a: i for i, a in enumerate(island.starts.tolist())}
    last = {b: i + 1 for i, b in enumerate(island.ends.tolist())}
    out, at = [], 0
    for kind, start, end in spans:
        if start not in first or end not in last:
            return None
        i, j = first[start], last[end]
        if i < at or j - i > island.longest:
            return None
        out += [(x + 1, 1, 0) for x in range(at, i)] + [(j, j - i, TYPES.index(kind))]
        at = j
    return out + [(x + 1, 1, 0) for x in range(at, island.n)]


def regrouped(body, rng):
    """The digits of a phone number in groups of two to four, under other marks; unchanged if a pattern takes that."""
    digits, mark = rng.choice(["", "0", "00"]) + re.sub("[^0-9]", "", body), rng.choice(" -./")
    groups, at = [], 0
    while at < len(digits):
        size = rng.randint(2, 4)
        groups.append(digits[at : at + size])
        at += size
    form = mark.join(groups)
    return body if certain_spans(form) else form


def weaker(text, spans, rng):
    """The same text and spans in spellings that the patterns miss."""
    out, labels, at, size = [], [], 0, 0
    for kind, start, end in spans:
        body = text[start:end]
        if kind == "phone":
            forms = [body[1:], re.sub(r"^\+[0-9]{1,3}[ -]?", "", body), body.replace("+", "00", 1), *(regrouped(body, rng) for _ in range(3))]
            body = rng.choice(forms) if len(body) > 12 else body
        elif kind == "email":
            body = body.replace("@", rng.choice([" (at) ", "[at]", "@"]))
        elif kind == "card":
            body = re.sub(r"(\d{4})(?=\d)", rng.choice([r"\1.", r"\1/", r"\1"]), re.sub(r"[ -]", "", body))
        elif kind == "ip":
            body = body.replace(".", rng.choice(["[.]", "."]))
        out += [text[at:start], body]
        size += start - at
        labels.append((kind, size, size + len(body)))
        size += len(body)
        at = end
    return "".join(out) + text[at:], labels


def spoiled(text, spans, rng):
    """The text with an ordinary figure in the place of every span, and no spans."""
    out, at = [], 0
    number = rng.randrange
    for _, start, end in spans:
        figure = rng.choice([
            f"{number(1, 29)}.{number(1, 13)}.{number(1900, 2030)}", f"{number(1900, 2030)}-{number(1, 13):02}-{number(1, 29):02}",
            f"{number(24)}:{number(60):02}", f"{number(1, 999)},{number(1000):03}", f"{number(99)}.{number(99)}", f"{number(9)}.{number(20)}.{number(20)}",
            str(number(10 ** rng.randint(1, 9))), f"{number(99)}/{number(99)}", f"{number(999)} {number(9999)}", f"({number(30)})", f"@{number(99)}",
        ])
        out += [text[at:start], figure]
        at = end
    return "".join(out) + text[at:], []


def parts_of(text, start, end, most=PART_CHARS):
    """An island in parts of at most ``most`` characters, cut behind the last white space if there is any."""
    while end - start > most:
        cut = start + most
        while cut > start and not text[cut - 1].isspace():
            cut -= 1
        cut = cut if cut > start else start + most
        yield start, cut
        start = cut
    yield start, end


def examples(values, rng):
    """Labelled islands of texts: as the patterns mark them, in weaker spellings, and with ordinary figures instead."""
    out = []
    for text in values:
        spans, kept, last = certain_spans(text), [], 0
        for span in spans:
            if span[1] >= last:
                kept.append(span)
                last = span[2]
        for form, marked in ((text, kept), weaker(text, kept, rng), spoiled(text, kept, rng)):
            for start, end in islands(form):
                own = [s for s in marked if s[1] < end and s[2] > start]
                island = Island(form, start, end)
                gold = gold_segments(island, own)
                if gold:
                    out.append((island, gold))
    return out


def fit(labelled, epochs=EPOCHS, rate=0.3, shrink=1e-3, seed=5):
    """Weights of features and moves between types, by adaptive gradient ascent."""
    weights, moves = np.zeros((N_FEATURES, len(TYPES))), np.zeros((len(TYPES), len(TYPES)))
    seen, seen_moves = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    # Nothing known yet: entities are rare.
    weights[0, 1:] = -2.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for at in rng.permutation(len(labelled)):
            grad, grad_moves = gradient(*labelled[at], weights, moves)
            grad, grad_moves = grad - shrink * weights, grad_moves - shrink * moves
            seen += grad**2
            seen_moves += grad_moves**2
            weights += rate * grad / np.sqrt(seen)
            moves += rate * grad_moves / np.sqrt(seen_moves)
    return weights, moves


def learn(
    spark, docs, train_docs=TRAIN_DOCS, train_texts=TRAIN_TEXTS, train_islands=TRAIN_ISLANDS, id_column="doc_id", text_column="text"
):
    """Train on at most ``train_islands`` islands, from ``train_texts`` different ones of about ``train_docs`` documents.

    Documents and islands are those of the smallest hashes. Null and empty texts have
    no islands; without any the model keeps its start, by which entities are rare.
    """

    def cut(stream):
        for batch in stream:
            parts = []
            for text in batch.column("text").to_pylist():
                for start, end in islands(text):
                    parts += [text[max(0, a - 24) : b + 1] for a, b in parts_of(text, start, end)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string())], names=["part"])

    kinds = [re.compile("@"), re.compile(r"\.[0-9]+\."), re.compile("[0-9]{12}"), re.compile(r"\+")]
    rows = (
        drawn(texts(docs, id_column, text_column), train_docs, docs.count())
        .where(F.col("text").rlike("[0-9@]"))
        .select("text")
        .mapInArrow(cut, "part string")
        .distinct()
        .orderBy(F.xxhash64("part"), "part")
        .limit(train_texts)
        .collect()
    )
    values = [r["part"] for r in rows]
    rng = random.Random(3)
    # Islands of all kinds, in turn, then any others.
    chosen, piles = [], [[v for v in values if k.search(v)] for k in kinds] + [values]
    for turn in range(max(map(len, piles), default=0)):
        chosen += [pile[turn] for pile in piles if turn < len(pile)]
    chosen = list(dict.fromkeys(chosen))[: train_islands // 3]
    return fit(examples(chosen, rng)[:train_islands])


def model_spans(text, model, known):
    """Entities of all islands; ``known`` remembers short islands already decoded."""
    weights, moves = model
    out = []
    for start, end in islands(text):
        key = (text[max(0, start - 24) : start], text[start:end], text[end : end + 1]) if end - start <= PART_CHARS else None
        found = known.get(key) if key else None
        if found is None:
            found = [(k, a - start, b - start) for k, a, b in best_segments(Island(text, start, end), weights, moves)]
            if key:
                if len(known) > 20_000:
                    known.clear()
                known[key] = found
        out += [(k, a + start, b + start) for k, a, b in found]
    return out


def all_spans(text, model, known=None):
    """Certain spans, and the model's that touch none of them, in order."""
    base = certain_spans(text)
    if model is None:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    out, at, reach = [], 0, 0
    for span in sorted(model_spans(text, model, {} if known is None else known), key=lambda s: s[1]):
        while at < len(taken) and taken[at][0] < span[2]:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= span[1]:
            out.append(span)
    return base, sorted(base + out, key=span_order(KINDS))


def find_personal_data(spark, docs, model, id_column="doc_id", text_column="text"):
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans``.

    Counts and ``base_spans`` are of the certain patterns, ``spans`` has the model's
    too. Offsets are code points, end exclusive. Of model spans that touch a certain one
    the certain one stays. Null text counts as empty and has no spans; very long texts
    are searched whole, in memory proportional to their length; repeated rows are
    searched each; an empty table gives no rows; other columns are not read.
    """
    shared = spark.sparkContext.broadcast(model)

    def scan(ids, values):
        known = {}
        found = [all_spans(text, shared.value, known) for text in values]
        out = {f"n_{kind}": [sum(s[0] == kind for s in base) for base, _ in found] for kind in KINDS}
        out["base_spans"] = [span_text(base) for base, _ in found]
        out["spans"] = [span_text(spans) for _, spans in found]
        return out

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"
    return map_texts(texts(docs, id_column, text_column), scan, schema)
