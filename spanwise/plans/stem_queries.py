"""Queries on the files of separated recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stems as S
from . import fixtures as T
from .registry import REGISTRY

_NAMES = ["(Vocals)", "no vocals", "Karaoke_v2", "DRUMS.take", "bassline", "sub-bass", "Others", "take without-vocal", "voice over", "mix"]
_WORDS = "regexp_replace(regexp_replace(lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1')), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g')"
_KIND = f"CASE WHEN regexp_matches(words, '{S.NO_VOCALS}') THEN 'accompaniment' " + " ".join(f"WHEN list_has_any(string_split(words, '_'), {names!r}) THEN '{k}'" for k, names in S.KINDS.items()) + " END"


@REGISTRY.query(
    "c39_stem_map",
    f"""WITH p AS (SELECT p_partkey // (2 + p_partkey // 100 % 3) AS song, 'out.d/' || p_partkey || ' - ' || {_NAMES!r}[CAST(1 + p_partkey * 7 % 10 AS INT)] || '.wav' AS path FROM part),
  w AS (SELECT *, {_WORDS} AS words FROM p), k AS (SELECT song, path, {_KIND} AS kind FROM w),
  m AS (SELECT song, kind, min(path) AS path FROM k WHERE kind IS NOT NULL GROUP BY 1, 2),
  two AS (SELECT song FROM p GROUP BY 1 HAVING count(*) = 2)
  SELECT * FROM m UNION ALL SELECT song, 'accompaniment', min(path) FROM p WHERE song IN (SELECT song FROM two) AND song IN (SELECT song FROM m WHERE kind = 'vocals') AND song NOT IN (SELECT song FROM m WHERE kind = 'accompaniment') AND path NOT IN (SELECT path FROM m WHERE kind = 'vocals') GROUP BY 1""",
)
def c39_stem_map(spark, sf):
    """Which file of a recording holds what. Parts are the files, a few in a row one recording."""
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (1 + k * 7 % 10).cast("int"))
    files = T.table(spark, sf, "part").select(F.floor(k / (2 + F.floor(k / 100) % 3)).alias("song"), F.concat(F.lit("out.d/"), k.cast("string"), F.lit(" - "), name, F.lit(".wav")).alias("path"))
    return S.stem_map(files, "song")
