"""The text packet of a track: sections as column expressions, joined by a blank line, absent sections left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import format_time, ladder

#: Which sections each mode shows: background, metrics, lyrics, frames; fixed values.
MODES = {"full": (True, True, True, True), "lyrics": (False, True, True, False), "context": (True, True, False, False), "blind": (False, True, False, False)}
METRICS_HEAD = "## Listener analysis\n\n"


def modes(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{m}', {', '.join(map(str, v))})" for m, v in MODES.items())
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v(mode, background, metrics, lyrics, frames)")


def _lines(*parts: Column) -> Column:
    """The non-null parts, one a line; null if there are none."""
    return F.nullif(F.concat_ws("\n", *parts), F.lit(""))


def _if(value: Column, text: str) -> Column:
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(text), value))


def context_text(value: Column) -> Column:
    """Text of a context field: a JSON object's ``extract`` when ``found`` is true, a plain string as it is."""
    as_json = F.try_parse_json(value)
    found = F.try_variant_get(as_json, "$.found", "boolean")
    is_object = F.coalesce(F.schema_of_variant(as_json).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.when(found, F.try_variant_get(as_json, "$.extract", "string"))).otherwise(value)


def header(artist: Column, title: Column, url: Column) -> Column:
    named = (F.coalesce(artist, F.lit("")) != "") | (F.coalesce(title, F.lit("")) != "")
    return _lines(F.when(named, F.lit("## Track\n")), _if(artist, "Artist: "), _if(title, "Title: "), _if(url, "Source: "))


def background(artist_text: Column, song_text: Column) -> Column:
    body = _lines(_if(artist_text, "Artist: "), _if(song_text, "Track: "))
    return F.when(body.isNotNull(), F.concat(F.lit("## Background\n\n"), body))


def metrics(row: dict[str, Column]) -> Column:
    """The metrics section from columns by name; those that lack leave their line out (None) or null it."""
    f = lambda pattern, *names: F.when(_all(row, names), F.format_string(pattern, *[row[n] for n in names])) if all(n in row for n in names) else F.lit(None)
    hp = row.get("hp_balance")
    hp_line = F.lit(None) if hp is None else F.format_string("HP balance: %.3f (%s)", hp, F.when(hp < -0.2, "harmonic dominant (tonal, warm)").when(hp > 0.2, "percussive dominant").otherwise("balanced"))
    mm, way = row.get("mean_major_minor"), row.get("mean_direction")
    mm_line = F.lit(None) if mm is None else F.format_string("\nMajor/minor balance: %.3f (%s)", mm, F.when(mm < -0.1, "minor-leaning").otherwise(ladder(mm, [(0.1, "major-leaning")], "neutral")))
    way_line = F.lit(None) if way is None else F.format_string("Mean direction: %.3f (%s)", way, F.when(way < -0.1, "predominantly falling").otherwise(ladder(way, [(0.1, "predominantly rising")], "flat")))
    duration = row.get("duration_seconds")
    body = _lines(
        F.lit(None) if duration is None else F.format_string("Duration: %s (%.1fs)", format_time(duration), duration),
        f("Tempo: %.1f BPM", "tempo_bpm"),
        f("\nMomentum: %.3f (listener engagement, 0-1)", "mean_momentum"),
        f("Pattern lock: %.3f (predictability/hold, 0-1)", "mean_pattern_lock"),
        f("Beat regularity: %.3f (metronomic pulse stability)", "beat_regularity"),
        f("Breath: %.1f%% building / %.1f%% releasing / %.1f%% sustaining", "breath_positive_pct", "breath_negative_pct", "breath_sustain_pct"),
        hp_line,
        mm_line,
        f("Mean tension: %.3f", "mean_tension"),
        f("\nVocal presence: %.3f (0=none, 1=dominant)", "mean_vocal_presence"),
        f("Melody contour: %.1f%% ascending / %.1f%% descending / %.1f%% holding", "contour_ascending_pct", "contour_descending_pct", "contour_holding_pct"),
        way_line,
    )
    return F.concat(F.lit(METRICS_HEAD), F.coalesce(body, F.lit("No structural analysis found for this track.")))


def _all(row: dict[str, Column], names) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & row[n].isNotNull()
    return ok


def event_lines(events: Column) -> Column:
    """The structural events (array of time, type, intensity, duration, depth_db, from, to), in order of time."""
    text = lambda e: F.concat(
        format_time(e.time),
        F.when(e.type == "silence", F.format_string(" - silence %.2fs at %.1fdB", F.coalesce(e.duration, F.lit(0.0)), F.coalesce(e.depth_db, F.lit(-80.0))))
        .when(e.type.startswith("momentum"), F.format_string(" - %s %.3f -> %.3f", e.type, F.coalesce(e["from"], F.lit(0.0)), F.coalesce(e["to"], F.lit(0.0))))
        .otherwise(F.format_string(" - pattern break (intensity %.3f)", F.coalesce(e.intensity, F.lit(0.0)))),
    )
    ordered = F.sort_array(F.transform(events, lambda e: F.struct(e.time.alias("time"), text(e).alias("x"))))
    return F.when(F.size(events) > 0, F.concat(F.lit("### Structural events\n\n"), F.array_join(F.transform(ordered, lambda s: s.x), "\n")))


def caption_section(captions: Column) -> Column:
    """From array<struct<seg, ts, text>> in order."""
    line = lambda c: F.concat(F.lit("["), c.ts, F.lit("]  "), F.coalesce(c.text, F.lit("")))
    return F.when(F.size(captions) > 0, F.concat(F.lit("## Lyrics - autocaptions (timestamps accurate; text may contain mishears)\n\n"), F.array_join(F.transform(captions, line), "\n")))


def lyrics_section(clean: Column, captions: Column, plain: Column) -> Column:
    """Captions and clean text, or else the plain text."""
    head = lambda h, c: F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(h), F.trim(c)))
    both = F.nullif(F.concat_ws("\n\n", caption_section(captions), head("## Lyrics - clean text, no timestamps\n\n", clean)), F.lit(""))
    return F.coalesce(both, head("## Lyrics\n\n", plain))


def frames_section(frames: Column) -> Column:
    """From array<struct<time, kind, type, intensity, description>>."""
    label = lambda f: F.concat(
        F.lit("["), format_time(f.time), F.lit("]"),
        F.when(f.kind == "coverage", F.lit(" (coverage)")).when(f.intensity.isNotNull(), F.format_string(" (%s, intensity %.2f)", f.type, f.intensity)).when(F.coalesce(f.type, F.lit("")) != "", F.concat(F.lit(" ("), f.type, F.lit(")"))).otherwise(""),
        F.lit("\n  "), F.coalesce(f.description, F.lit("")), F.lit("\n"),
    )
    head = "## Visual context (video frames at structural moments)\n\nThe descriptions are optional context; the music stands alone.\n\n"
    return F.when(F.size(frames) > 0, F.concat(F.lit(head), F.array_join(F.transform(frames, label), "\n")))


def packet(mode: str = "full", template: str | None = None, **sections: str) -> Column:
    """The packet of one mode from the named section columns (background, header, metrics, lyrics, frames)."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; choose from {', '.join(MODES)}")
    show = dict(zip(("background", "metrics", "lyrics", "frames"), MODES[mode], strict=True)) | {"header": mode != "blind"}
    parts = [F.lit(template.strip()), F.lit("\n---\n")] if template else []
    parts += [F.nullif(F.col(sections[k]), F.lit("")) for k in ("background", "header", "metrics", "lyrics", "frames") if show[k] and k in sections]
    return F.concat_ws("\n\n", *parts)
