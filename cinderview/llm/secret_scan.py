"""Secret scan: certain secrets by pattern, weak ones only as parts of a whole credential.

Three patterns find certain secrets (``assign``, ``access``, ``hex``). Access
identifiers, loose secrets and endpoints alone are too common to report. They are
joined by interval: every secret's span, widened by the scope, is met with the
identifiers and endpoints it overlaps, and a weak part is reported only if a
complementary part lies in its scope:

- an identifier (``id``) or an endpoint (``endpoint``) needs a secret,
- a loose secret (``key``) needs an identifier or an endpoint.

Certain secrets take part as complements. The join is a sweep over sorted spans
of one text, so nothing is shuffled, and a text costs n log n of its candidates.
"""

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import functions as F

from .common import map_texts, span_order, span_text, texts

# Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
LINKED_KINDS = ("id", "key", "endpoint")
KINDS = BASE_KINDS + LINKED_KINDS

# Patterns and least lengths of certain secrets.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

# Weak parts of a credential, as long as they are. An empty group ends the least length.
IDENTIFIER = re.compile(
    r"""(?ai)\b(?:user(?:_?name|_?id)?|login|account(?:_?id)?|client_?id|access_?key_?id|key_?id|tenant(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3}()[A-Za-z0-9@_.-]*|\b(?:AKIA|ASIA)[A-Z0-9]{4,}\b"""
)
ENDPOINT = re.compile(
    r"""(?ai)\b(?:https?|jdbc:[a-z0-9]{2,}|s3|ftp|ssh|amqps?|rediss?|postgres(?:ql)?|mysql|mongodb)://[A-Za-z0-9._~:/@%-]{3}()[A-Za-z0-9._~:/@%-]*|\b(?:host(?:name)?|endpoint|server|base_?url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3}()[A-Za-z0-9._:/-]*"""
)
LOOSE_KEY = re.compile(
    r"""(?ai)\b(?:pwd|pass|passphrase|password|passwd|secret|token|api_?key|auth|bearer|credentials?|private_?key|secret_?key|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=!@#$%^&*-]{6}()[A-Za-z0-9+/_.=!@#$%^&*-]*"""
)
BARE_KEY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")

SCOPE_CHARS = 400


def certain_secrets(text):
    """``[(kind, start, end)]`` of the three patterns, each leftmost and without overlap in its kind."""
    low = text.lower()
    spans = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        # A match that is too short still uses up its characters.
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans.sort(key=span_order(KINDS))
    return spans


def looks_random(token):
    """Mixed letters and digits without the regularity of words."""
    return (
        any(c.isdigit() for c in token)
        and any(c.isupper() for c in token)
        and any(c.islower() for c in token)
        and len(set(token)) >= 12
    )


def least_spans(pattern, text):
    """``(start, end of the least length, end)`` of every match."""
    return [(m.start(), m.end(m.lastindex or 0), m.end()) for m in pattern.finditer(text)]


def free_spans(kind, found, taken):
    """Spans that up to their least length touch none of ``taken`` (sorted, ``(start, end)``), and do not touch each other.

    A long value goes on over a stronger span inside it.
    """
    starts = [start for start, _ in taken]
    reach = []
    for _, end in taken:
        reach.append(max(end, reach[-1]) if reach else end)
    out, last = [], 0
    for start, least, end in found:
        at = bisect_left(starts, least)
        if start >= last and not (at and reach[at - 1] > start):
            out.append((kind, start, end))
            last = end
    return out


def meets(spans, others, scope):
    """The spans that, widened by ``scope``, overlap one of ``others``: a sweep over both, sorted."""
    others = sorted((start, end) for _, start, end in others)
    starts = [start for start, _ in others]
    reach = []
    for _, end in others:
        reach.append(max(end, reach[-1]) if reach else end)
    out = []
    for span in spans:
        at = bisect_left(starts, span[2] + scope)
        if at and reach[at - 1] > span[1] - scope:
            out.append(span)
    return out


def linked_secrets(text, base, scope=SCOPE_CHARS):
    """Weak parts that complement each other or a certain secret."""
    taken = sorted((start, end) for _, start, end in base)
    ends = free_spans("endpoint", least_spans(ENDPOINT, text), taken)
    taken_too = sorted(taken + [s[1:] for s in ends])
    ids = free_spans("id", least_spans(IDENTIFIER, text), taken_too)
    strong_ids = [s for s in base if s[0] == "access"]
    if not ids and not ends and not strong_ids:
        return []
    taken_too = sorted(taken_too + [s[1:] for s in ids])
    loose = least_spans(LOOSE_KEY, text)
    bare = [x for x in least_spans(BARE_KEY, text) if looks_random(text[x[0] : x[2]])]
    keys = free_spans("key", loose, taken_too)
    keys += free_spans("key", bare, sorted(taken_too + [s[1:] for s in keys]))
    keys = sorted(keys, key=lambda s: s[1])
    secrets = keys + [s for s in base if s[0] != "access"]
    return meets(keys, ids + ends + strong_ids, scope) + meets(ids, secrets, scope) + meets(ends, secrets, scope)


def secret_spans(text, scope=SCOPE_CHARS):
    """``(certain spans, all spans)`` of one text, in order; empty text has none."""
    base = certain_secrets(text)
    return base, sorted(base + linked_secrets(text, base, scope), key=span_order(KINDS))


def scan_secrets(docs, scope=SCOPE_CHARS, id_column="doc_id", text_column="text"):
    """One row per row of ``docs``: ``doc_id, n_assign, n_access, n_hex, base_spans, spans``.

    Spans are code point offsets, end exclusive, as ``kind:start:end`` joined by
    commas. Null text counts as empty and has no spans; a row without an id is
    scanned like any other; repeated rows are scanned each; very long texts are
    scanned whole, in memory proportional to their candidates; of spans that start
    together the kind listed first comes first; an empty table gives no rows;
    columns other than id and text are not read.
    """

    def scan(ids, values):
        found = [secret_spans(text, scope) for text in values]
        out = {f"n_{kind}": [sum(s[0] == kind for s in base) for base, _ in found] for kind in BASE_KINDS}
        out["base_spans"] = [span_text(base) for base, _ in found]
        out["spans"] = [span_text(spans) for _, spans in found]
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"
    return map_texts(texts(docs, id_column, text_column), scan, schema)


def without_spans(text, spans, mark):
    """``text`` with every span, overlapping ones merged, replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs, mark="[SECRET]", scope=SCOPE_CHARS):
    """The same rows and columns with every reported secret in ``text`` replaced by ``mark``.

    ``n_chars``, where there is one, becomes the new length. Null text stays null.
    """
    def run(stream):
        for batch in stream:
            place = batch.schema.get_field_index("text")
            new = [t if t is None else without_spans(t, secret_spans(t, scope)[1], mark) for t in batch.column(place).to_pylist()]
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out
