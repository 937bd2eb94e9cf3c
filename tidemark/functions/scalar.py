"""Scalar derivations, predicates and text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def ladder(x: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first bound that x exceeds."""
    out = None
    for bound, label in steps:
        out = F.when(x > bound, label) if out is None else out.when(x > bound, label)
    return out.otherwise(otherwise)


def scaled_round(c: Column, n: int) -> Column:
    """The nearest whole number of 10^-n to the product in doubles, halves away from zero, as the SQL's round(); Spark's own goes by the decimals shown."""
    return F.round(c * F.lit(10.0**n)) / F.lit(10.0**n)


# Label ladders; fixed values.
def rhythm_label(x: Column) -> Column:
    return ladder(x, [(0.9, "metronomic"), (0.7, "steady"), (0.5, "loose")], "free")


def character_label(x: Column) -> Column:
    return ladder(x, [(0.6, "percussive"), (0.45, "balanced"), (0.35, "melodic-rhythmic"), (0.2, "melodic")], "harmonic")


def brightness_label(x: Column) -> Column:
    return ladder(x, [(3000, "bright"), (2000, "balanced"), (1200, "warm")], "dark")


def dynamics_label(x: Column) -> Column:
    return ladder(x, [(50, "extreme"), (20, "wide"), (5, "moderate")], "compressed")


def texture_label(x: Column) -> Column:
    return ladder(x, [(5, "dense"), (2, "moderate"), (0.5, "sparse")], "minimal")


def hz_to_midi(hz: Column) -> Column:
    return F.when(hz > 0, 12 * F.log2(hz / 440.0) + 69)


def hz_to_note(hz: Column) -> Column:
    """Note name with octave; ``?`` for null, NaN or hz <= 0."""
    midi = F.bround(hz_to_midi(hz)).cast("int")
    name = F.element_at(F.array(*map(F.lit, NOTES)), F.pmod(midi, F.lit(12)) + 1)
    known = hz.isNotNull() & ~F.isnan(hz) & (hz > 0)
    return F.when(known, F.concat(name, (F.floor(midi / 12) - 1).cast("string"))).otherwise("?")


def hz_to_cents(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), 1200 * F.log2(b / a)).otherwise(float("inf"))


def hp_balance(h: Column, p: Column, least: float = 0.0) -> Column:
    """(p - h) / (p + h) when the sum exceeds ``least``, else 0."""
    return F.when(p + h > least, (p - h) / F.nullif(p + h, F.lit(0.0))).otherwise(0.0)


def percussion_ratio(h: Column, p: Column) -> Column:
    return F.coalesce(F.try_divide(p, p + h), F.lit(0.0))


def format_time(s: Column) -> Column:
    whole = F.floor(s).cast("long")
    return F.format_string("%d:%02d", (whole / 60).cast("long"), whole % 60)


def format_timestamp(s: Column) -> Column:
    """M:SS.cc"""
    return F.format_string("%d:%05.2f", (F.floor(s).cast("long") / 60).cast("long"), s - F.floor(s / 60) * 60)


def parse_timestamp(text: Column) -> Column:
    """Seconds of H:M:S, M:S or S; a comma counts as a point; what can't be read is 0."""
    parts = F.split(F.replace(F.trim(text), F.lit(","), F.lit(".")), ":")
    n = F.size(parts)
    whole = lambda i: F.try_to_number(F.trim(F.get(parts, F.lit(i))), F.lit("999999")).cast("double")
    real = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    out = F.when(n == 3, whole(0) * 3600 + whole(1) * 60 + real(2)).when(n == 2, whole(0) * 60 + real(1)).otherwise(real(0))
    return F.coalesce(out, F.lit(0.0))


def format_delta(a: Column, b: Column) -> Column:
    d = b - a
    return F.when(F.abs(d) < 0.0005, "  =").otherwise(F.format_string("%s %+.3f", F.when(d > 0, ">").otherwise("<"), F.abs(d)))


def divergence_marker(x: Column) -> Column:
    return ladder(x, [(0.5, "##"), (0.2, "++"), (0.1, "..")], "")


def encode_image(content: Column) -> Column:
    """An image's bytes as base64 text."""
    return F.base64(content)


def valid_slug(s: Column) -> Column:
    return s.rlike(r"^[A-Za-z0-9._-]+$") & ~s.isin(".", "..")


def valid_video_url(s: Column) -> Column:
    return s.rlike(r"^https?://(www\.)?(youtube\.com/watch\?.*v=|youtu\.be/)[A-Za-z0-9_\-]{11}")


#: What the downloader's log says of a challenge failure; fixed values.
CHALLENGE_MARKERS = ("remote components challenge solver", "challenge solving failed", "n challenge", "some formats may be missing", "ejs")


def is_challenge_failure(log: Column) -> Column:
    """The downloader's log names a challenge failure, after which one retry is due."""
    out = F.lit(False)
    for marker in CHALLENGE_MARKERS:
        out = out | F.lower(log).contains(marker)
    return out


#: What a slug loses or turns into another text, in order, before and after blanks become hyphens; fixed values.
SLUG_FIRST = ((r"\([^)]*\)", ""), (r"\[[^\]]*\]", ""), ("[–—/|]+", " "), (r"\bft\..*$|\bfeat\..*$", ""), (r"[^a-z0-9\s-]", ""))
SLUG_THEN = ((r"\s+", "-"), ("-{2,}", "-"), ("^-+|-+$", ""))


def slugify(s: Column) -> Column:
    out = F.lower(s)
    for pattern, by in SLUG_FIRST:
        out = F.regexp_replace(out, pattern, by)
    out = F.trim(out)
    for pattern, by in SLUG_THEN:
        out = F.regexp_replace(out, pattern, by)
    return F.substring(out, 1, 80)


def artist_title(title: Column, uploader: Column) -> Column:
    """struct<artist, title> of a video title."""
    pattern = r"^(.+?)\s*[-–—]\s*(.+)$"
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s*[\(\[].*", ""))
    has = title.rlike(pattern)
    return F.struct(
        F.when(has, F.trim(F.regexp_extract(title, pattern, 1))).otherwise(uploader).alias("artist"),
        F.when(has, clean(F.trim(F.regexp_extract(title, pattern, 2)))).otherwise(clean(title)).alias("title"),
    )


def align_words(text: Column) -> Column:
    """Lower-cased words of two or more characters, for overlap scores."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", " "), r"(?U)\s+"), lambda w: F.char_length(w) > 1)


def word_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two word arrays; 0 when either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def wrong_article(query: Column, title: Column) -> Column:
    """No word of the query longer than two characters stands in the title."""
    long = F.filter(F.split(F.lower(query), r"\s+"), lambda w: F.char_length(w) > 2)
    return (F.size(long) > 0) & ~F.arrays_overlap(long, F.split(F.lower(title), r"\s+"))


#: Explicit terms and what stands for them, in order; fixed values.
CENSOR = (
    (r"\bnigga(s)?\b", "n***a"),
    (r"\bnigger(s)?\b", "n*****"),
    (r"\bmotherfuck\w*", "mf"),
    (r"\bfucking\b", "f***ing"),
    (r"\bfucked\b", "f***ed"),
    (r"\bfucker(s)?\b", "f***er"),
    (r"\bfuck\b", "f***"),
    (r"\bshit\b", "s***"),
    (r"\bbitch(es)?\b", "b****"),
    (r"\bcunt\b", "c***"),
)


def censor(text: Column) -> Column:
    for pattern, by in CENSOR:
        text = F.regexp_replace(text, f"(?i){pattern}", by)
    return text


def strip_tags(html: Column) -> Column:
    """Markup to lines: breaks become newlines, tags go, the common entities are read."""
    out = F.regexp_replace(html, r"<br\s*/?>", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "<[^>]+>", ""), "<[^>]*$", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out
