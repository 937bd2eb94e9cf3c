"""Queries over captions, lyrics, pages, prompts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import captions as C
from ..session import table
from ..sources import analysis as A
from . import bindings as B
from . import prompt as P
from .queries import QUERIES, SQL, query, r

SPLIT = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
#: Length of the longest end of list a that list b begins with.
LAP = "coalesce(list_max(list_filter(range(1, least(len({a}), len({b})) + 1), lambda k: ({a})[len({a}) - k + 1 : len({a})] = ({b})[1 : k])), 0)"
SEGMENTS = f"sg AS (SELECT conv_id AS track, turn AS seg, turn * 4.0::DOUBLE AS start, {SPLIT.format('text')} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)"


@query(f"""WITH RECURSIVE {SEGMENTS}, fo AS (SELECT track, k, w AS acc FROM sg WHERE k = 1 UNION ALL SELECT s.track, s.k, list_concat(f.acc, s.w[{LAP.format(a='f.acc', b='s.w')} + 1 :]) FROM fo f JOIN sg s ON s.track = f.track AND s.k = f.k + 1)
SELECT track, array_to_string(arg_max(acc, k), ' ') AS full_text, max(k)::BIGINT AS n_segments FROM fo GROUP BY track""")
def caption_dedup(spark, d):
    return C.dedup_captions(B.captions(spark, d))


@query(f"""WITH RECURSIVE {SEGMENTS}, fo AS (
  SELECT track, 0::BIGINT AS k, []::VARCHAR[] AS seen, []::VARCHAR[] AS held, NULL::DOUBLE AS since, NULL::DOUBLE AS out_at, NULL::VARCHAR AS out_text FROM sg WHERE k = 1
  UNION ALL SELECT track, k, list_concat(seen, novel), CASE WHEN full_ THEN [] ELSE words END, CASE WHEN full_ OR len(words) = 0 THEN NULL ELSE fresh END, CASE WHEN full_ THEN fresh END, CASE WHEN full_ THEN array_to_string(words, ' ') END
  FROM (SELECT *, len(words) >= 8 AND len(novel) > 0 AS full_ FROM (SELECT *, list_concat(held, novel) AS words, CASE WHEN len(novel) > 0 THEN coalesce(since, start) ELSE since END AS fresh
    FROM (SELECT s.track, s.k, f.seen, f.held, f.since, s.start, s.w[{LAP.format(a='f.seen', b='s.w')} + 1 :] AS novel FROM fo f JOIN sg s ON s.track = f.track AND s.k = f.k + 1)))),
ln AS (SELECT track, k, out_at AS start, out_text AS text FROM fo WHERE out_text IS NOT NULL UNION ALL SELECT track, k + 1, since, array_to_string(held, ' ') FROM (SELECT * FROM fo QUALIFY row_number() OVER (PARTITION BY track ORDER BY k DESC) = 1) WHERE len(held) > 0)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY k)::BIGINT - 1 AS line, start, text FROM ln""")
def caption_lines(spark, d):
    return C.caption_lines(B.captions(spark, d))


BAG = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 1))"


@query(f"""WITH RECURSIVE seg AS (SELECT conv_id AS track, turn * 4.0::DOUBLE AS start, {BAG} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
ly AS (SELECT conv_id AS track, turn AS line, text, {BAG} AS w, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant'),
sc AS (SELECT l.track, l.k, s.j, s.start, len(list_intersect(l.w, s.w)) / len(list_distinct(list_concat(l.w, s.w)))::DOUBLE AS score FROM ly l JOIN seg s USING (track) WHERE len(l.w) > 0 AND len(s.w) > 0),
al AS (SELECT track, 0::BIGINT AS k, 0::BIGINT AS pos, max(n) AS n, NULL::DOUBLE AS start, 0.0::DOUBLE AS score FROM seg GROUP BY track
  UNION ALL SELECT track, k, CASE WHEN len(w) = 0 THEN pos WHEN best.score >= 0.12 THEN best.j ELSE least(pos + 1, n - 1) END, n, CASE WHEN best.score >= 0.12 THEN best.start END, CASE WHEN best.score >= 0.12 THEN round(best.score, 3) ELSE 0.0 END
  FROM (SELECT a.track, l.k, a.pos, a.n, any_value(l.w) AS w, max({{'score': sc.score, 'first': -sc.j, 'j': sc.j, 'start': sc.start}}) AS best
    FROM al a JOIN ly l ON l.track = a.track AND l.k = a.k + 1 LEFT JOIN sc ON sc.track = l.track AND sc.k = l.k AND sc.j >= a.pos AND sc.j < a.pos + 15 GROUP BY a.track, l.k, a.pos, a.n))
SELECT ly.track, ly.line, ly.text, al.start, al.score + 0.0 AS align_score FROM al JOIN ly USING (track, k)""")
def align_lyrics(spark, d):
    c = B.captions(spark, d)
    return C.align_lyrics(c.where("role = 'assistant'").select("track", F.col("seg").alias("line"), "text"), c)


CUES = r"""cu AS (SELECT conv_id AS track, row_number() OVER (PARTITION BY conv_id ORDER BY turn, x) AS k, turn * 4.0 + x AS start, regexp_replace(trim(regexp_replace(text, '<[^>]+>', '', 'g')), '[ ]*\n[ ]*', ' ', 'g') AS said FROM conversations, range(2) AS v(x) WHERE trim(text) <> ''),"""


@query(f"""WITH RECURSIVE {CUES} fo AS (SELECT track, 0::BIGINT AS k, []::VARCHAR[] AS recent, NULL::DOUBLE AS start, NULL::VARCHAR AS text FROM cu WHERE k = 1
  UNION ALL SELECT f.track, c.k, CASE WHEN list_contains(f.recent, c.said) THEN f.recent ELSE list_concat(f.recent, [c.said])[-5 :] END, CASE WHEN NOT list_contains(f.recent, c.said) THEN c.start END, CASE WHEN NOT list_contains(f.recent, c.said) THEN c.said END FROM fo f JOIN cu c ON c.track = f.track AND c.k = f.k + 1)
SELECT track, row_number() OVER (PARTITION BY track ORDER BY k)::BIGINT - 1 AS seg, start::DOUBLE AS start, text FROM fo WHERE text IS NOT NULL""")
def cue_files(spark, d):
    """Each conversation as a WebVTT file: every turn twice, a second apart, tagged."""
    c = B.captions(spark, d).where(F.trim("text") != "")
    cue = lambda s: F.concat(S.format_timestamp(s), F.lit(" --> x\n<c>"), F.col("text"), F.lit("</c>\n\n"))
    files = c.groupBy("track").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", F.concat(cue(F.col("start")), cue(F.col("start") + 1)).alias("x")))), lambda s: s.x), "").alias("body"))
    return A.cues(files.select("track", F.concat(F.lit("WEBVTT\n\n"), "body").alias("value")))


# ---- lyric pages ------------------------------------------------------------------------------------------------
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(x: str) -> str:
    for entity, char in ENTITIES:
        x = f"replace({x}, '{entity}', '{char}')"
    return x


NOISE = " OR ".join(f"contains(line, '{n}')" for n in C.PAGE_NOISE)


@query(f"""WITH x AS (SELECT page_id, unnest(string_split({unescaped("regexp_replace(regexp_replace(regexp_replace(html, '<br[ ]*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), '<[^>]*$', '', 'g')")}, chr(10))) AS line FROM pages)
SELECT page_id, count(*)::BIGINT AS lines, sum(length(trim(line)))::BIGINT AS chars FROM x WHERE trim(line) <> '' AND length(trim(line)) < 200 AND NOT ({NOISE}) GROUP BY page_id""")
def html_lines(spark, d):
    x = table(spark, d, "pages").select("page_id", F.explode(F.split(S.strip_tags(F.col("html")), "\n")).alias("line")).withColumn("line", F.trim("line"))
    return x.where((F.col("line") != "") & C.keep_line(F.col("line"))).groupBy("page_id").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"))


@query("""WITH o AS (SELECT item_id, item_id % 3 AS m, list_filter(regexp_split_to_array(text, '[ ]+'), lambda w: w <> '') AS w FROM benchmark), q AS (SELECT *, w[1:4] AS a, w[5:8] AS b FROM o WHERE len(w) >= 1), z AS (
SELECT item_id, array_to_string(list_filter([array_to_string(a, ' '), CASE WHEN len(b) > 0 THEN array_to_string(b, ' ') || ' & co' END, CASE WHEN m = 1 THEN 'second part' END], lambda x: x IS NOT NULL), ' / ') AS joined,
  CASE WHEN m = 1 THEN 'Verse / Hook' ELSE 'Verse' END AS sections FROM q) SELECT item_id, replace(joined, chr(10), ' / ') AS lines, sections FROM z""")
def lyric_pages(spark, d):
    """Pages built around benchmark items: a container that stands twice, noise lines, for some a second container, an end mark."""
    w = F.filter(F.split("text", " +"), lambda x: x != "")
    line = lambda i: F.array_join(F.slice("_w", i, 4), " ")
    box = lambda body: F.concat(F.lit('<div data-lyrics-container="true" class="x"><br>'), body, F.lit("</div>"))
    first = box(F.concat(F.lit("[Verse]<br/>"), line(1), F.when(F.size("_w") > 4, F.concat(F.lit("<br><i>"), line(5), F.lit(" &amp; co</i>"))).otherwise(""), F.lit("<br>12Embed<br>Lyrics should be typed")))
    second = F.when(F.col("item_id") % 3 == 1, box(F.lit("[Hook]<br>second part"))).otherwise("")
    x = table(spark, d, "benchmark").withColumn("_w", w).where(F.size("_w") >= 1)
    pages = x.select("item_id", F.concat(F.lit("<html>"), first, first, second, F.lit("You might also like<br>no lyric</html>")).alias("html"))
    out = A.lyric_pages(pages, "item_id", "html")
    return out.select("item_id", F.array_join("lines", " / ").alias("lines"), F.array_join("sections", " / ").alias("sections"))


# ---- titles -----------------------------------------------------------------------------------------------------
@query(r"""WITH t AS (SELECT conv_id, turn, text AS title FROM conversations WHERE text IS NOT NULL), d AS (SELECT *, regexp_extract(title, '^(.+?)\s*[-–—]\s*(.+)$', 1) AS a, regexp_extract(title, '^(.+?)\s*[-–—]\s*(.+)$', 2) AS b, regexp_matches(title, '^(.+?)\s*[-–—]\s*(.+)$') AS has FROM t)
SELECT conv_id, turn, CASE WHEN has THEN trim(a) ELSE 'uploader' END AS artist, trim(regexp_replace(CASE WHEN has THEN trim(b) ELSE title END, '\s*[\(\[].*', '')) AS title FROM d""")
def artist_title(spark, d):
    x = table(spark, d, "conversations").where("text IS NOT NULL")
    return x.select("conv_id", "turn", S.artist_title(F.col("text"), F.lit("uploader")).alias("x")).select("conv_id", "turn", "x.artist", "x.title")


@query(r"""WITH x AS (SELECT p_partkey, p_name, lead(p_name, 1, p_name) OVER (ORDER BY p_partkey) AS nxt FROM part), w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '\s+'), lambda w: length(w) > 2) AS q, regexp_split_to_array(lower(nxt), '\s+') AS t FROM x)
SELECT p_partkey, len(q) > 0 AND len(list_intersect(q, t)) = 0 AS wrong FROM w""")
def wrong_article(spark, d):
    """Each part's name against the next one's."""
    x = table(spark, d, "part").withColumn("_n", F.lead("p_name", 1).over(Window.orderBy("p_partkey")))
    return x.select("p_partkey", S.wrong_article(F.col("p_name"), F.coalesce("_n", "p_name")).alias("wrong"))


@query("""SELECT conv_id, turn, regexp_matches(lower(text), 'remote components challenge solver|challenge solving failed|n challenge|some formats may be missing|ejs') AS retry, (length(text) * 1.0::DOUBLE - turn) AS a FROM conversations WHERE text IS NOT NULL""")
def retry_predicate(spark, d):
    return table(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", S.is_challenge_failure(F.col("text")).alias("retry"), (F.char_length("text") - F.col("turn")).cast("double").alias("a"))


@query("""SELECT event_id, CASE WHEN abs(b - a) < 0.0005 THEN '  =' ELSE (CASE WHEN b > a THEN '>' ELSE '<' END) || ' ' || '+' || format('{:.3f}', abs(b - a)) END AS delta FROM (SELECT event_id, round(value, 3) AS a, CASE WHEN event_id % 5 = 0 THEN round(value, 3) ELSE round(value, 3) + (event_id % 7 - 3) * 0.125 END AS b FROM events)""")
def format_delta(spark, d):
    a = F.round("value", 3)
    b = F.when(F.col("event_id") % 5 == 0, a).otherwise(a + (F.col("event_id") % 7 - 3) * 0.125)
    return table(spark, d, "events").select("event_id", S.format_delta(a, b).alias("delta"))


# ---- prompts ----------------------------------------------------------------------------------------------------
TEXTS = """tx AS (SELECT doc_id, text, lang, source, n_chars, n_chars::DOUBLE / 997 AS v FROM documents),
se AS (SELECT doc_id,
  nullif(concat_ws(chr(10), CASE WHEN coalesce(lang, '') <> '' OR coalesce(source, '') <> '' THEN '## Track' || chr(10) END, CASE WHEN coalesce(lang, '') <> '' THEN 'Artist: ' || lang END, CASE WHEN coalesce(source, '') <> '' THEN 'Title: ' || source END), '') AS header,
  CASE WHEN coalesce(source, '') <> '' THEN '## Background' || chr(10) || chr(10) || 'Artist: ' || source END AS background,
  '## Listener analysis' || chr(10) || chr(10) || coalesce(nullif(concat_ws(chr(10), 'Duration: ' || (floor(v)::BIGINT // 60)::VARCHAR || ':' || lpad((floor(v)::BIGINT % 60)::VARCHAR, 2, '0') || ' (' || format('{:.1f}', v) || 's)',
    'Tempo: ' || format('{:.1f}', v * 10) || ' BPM', 'HP balance: ' || format('{:.3f}', v - 1) || ' (' || CASE WHEN v - 1 < -0.2 THEN 'harmonic dominant (tonal, warm)' WHEN v - 1 > 0.2 THEN 'percussive dominant' ELSE 'balanced' END || ')',
    chr(10) || 'Major/minor balance: ' || format('{:.3f}', 0.5 - v) || ' (' || CASE WHEN 0.5 - v < -0.1 THEN 'minor-leaning' WHEN 0.5 - v > 0.1 THEN 'major-leaning' ELSE 'neutral' END || ')',
    'Mean direction: ' || format('{:.3f}', v - 0.5) || ' (' || CASE WHEN v - 0.5 < -0.1 THEN 'predominantly falling' WHEN v - 0.5 > 0.1 THEN 'predominantly rising' ELSE 'flat' END || ')'), ''), 'No structural analysis found for this track.') AS metrics,
  CASE WHEN trim(coalesce(text, '')) <> '' THEN '## Lyrics' || chr(10) || chr(10) || trim(text) END AS lyrics FROM tx WHERE n_chars IS NOT NULL)"""


def _sections(spark, d):
    x = table(spark, d, "documents").where("n_chars IS NOT NULL").withColumn("v", F.col("n_chars").cast("double") / 997)
    none = F.lit(None).cast("string")
    v = F.col("v")
    row = {"duration_seconds": v, "tempo_bpm": v * 10, "hp_balance": v - 1, "mean_major_minor": 0.5 - v, "mean_direction": v - 0.5}
    captions = F.lit(None).cast("array<struct<seg:bigint,ts:string,text:string>>")
    return x.withColumns({"header": P.header(F.col("lang"), F.col("source"), none), "background": P.background(F.col("source"), none), "metrics": P.metrics(row), "lyrics": P.lyrics_section(none, captions, F.col("text"))})


def _mode(mode: str, parts: list[str]):
    def run(spark, d):
        x = _sections(spark, d)
        return x.select("doc_id", F.sha2(P.packet(mode, "T", background="background", header="header", metrics="metrics", lyrics="lyrics"), 256).alias("prompt_sha256"))

    QUERIES[f"prompt_{mode}"] = run
    joined = ", ".join(f"nullif({p}, '')" for p in parts)
    SQL[f"prompt_{mode}"] = f"WITH {TEXTS} SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), 'T', chr(10) || '---' || chr(10), {joined})) AS prompt_sha256 FROM se"


for _name, _parts in (("full", ["background", "header", "metrics", "lyrics"]), ("lyrics", ["header", "metrics", "lyrics"]), ("context", ["background", "header", "metrics"]), ("blind", ["metrics"])):
    _mode(_name, _parts)


@query("""WITH t AS (SELECT conv_id, '## Lyrics - autocaptions (timestamps accurate; text may contain mishears)' || chr(10) || chr(10) || string_agg('[' || (turn * 4 // 60)::VARCHAR || ':' || lpad((turn * 4 % 60)::VARCHAR, 2, '0') || '.00]  ' || coalesce(text, ''), chr(10) ORDER BY turn, text) AS captions, string_agg(text, ' ' ORDER BY turn, text) AS whole FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(captions || CASE WHEN trim(coalesce(whole, '')) <> '' THEN chr(10) || chr(10) || '## Lyrics - clean text, no timestamps' || chr(10) || chr(10) || trim(whole) ELSE '' END) AS lyrics_sha256 FROM t""")
def lyrics_sections(spark, d):
    c = B.captions(spark, d).withColumn("ts", S.format_timestamp(F.col("start")))
    x = c.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("seg", "ts", "text"))).alias("_c"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seg", "text")))), lambda s: s.text), " ").alias("_w"))
    return x.select(F.col("track").alias("conv_id"), F.sha2(P.lyrics_section(F.col("_w"), F.col("_c"), F.lit(None).cast("string")), 256).alias("lyrics_sha256"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN source END WHEN doc_id % 3 = 1 THEN source END AS shown FROM documents""")
def context_text(spark, d):
    """A field that is a JSON object (found or not), a plain text, or null."""
    obj = F.to_json(F.struct((F.col("doc_id") % 2 == 0).alias("found"), F.col("source").alias("extract")))
    field = F.when(F.col("doc_id") % 3 == 0, obj).when(F.col("doc_id") % 3 == 1, F.col("source"))
    return table(spark, d, "documents").select("doc_id", P.context_text(field).alias("shown"))


@query("SELECT page_id, base64(encode(html)) AS image FROM pages")
def base64_image(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(S.encode_image(F.encode("html", "UTF-8")), "[\r\n]", "").alias("image"))
