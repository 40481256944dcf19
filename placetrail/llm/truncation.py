"""Texts that lost their end (problem 8), by word trigrams inside texts and at ends, in SQL.

A text is cut into words, with one stop token for whatever can end a sentence (marks, line ends, links, smileys, code).
Over all texts, each trigram is counted *inside* (a word follows it) and *at ends* (a stop or the end of a text follows it;
apart from that, a trigram with a blank behind it, where the text ends with this blank). The final trigram of each text is
joined to these counts. It is cut where that trigram is frequent inside but almost never at an end (inside a sentence), or
where it is no trigram by itself but the beginning of those that go on with more letters (inside a word). A trigram too
rare for a count leans on its bigram, and that on its last word; ``context`` tells how many words decided.

Two further signs don't need counts: an element or entity of markup that is open at the end, and, where most texts of a
source that have exactly one length stop so, that length as the source's field limit for texts without a finished end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrail.plans.session import cut

#: Signatures and device marks behind the post's own text: separator line, then at most three lines.
SIGNATURE = (
    r"(?s)(\r?\n(-- ?|_{5,})\r?\n[^\n]{0,200}(\r?\n[^\n]{0,200}){0,2}|\r?\n<hr ?/?>\s*<small>[^\n]{0,300}"
    r"|\r?\nSent from my [^\n]{0,100})\s*$"
)
#: What a text with a signature holds behind a line end; the others are spared the pattern.
SIGNATURE_OPENS = ("--", "_____", "<hr", "Sent from my ")
#: What may stand behind a finished text: closing or empty elements, stops, smileys, symbols, edit notes; or a link.
FINISHED = (
    r"(?i)([.!?。！？؟।)\]}>\"”»’*_~`|/\\^=]|…|[:;]-?[)(/|DPp\]]|[\p{So}\p{Sk}\p{Cs}\x{FE0F}\x{200D}]|\^\^|[:;]['-]?[/\\|)(DPO3])\s*$"
)
#: What an open element, bracket or entity of markup looks like behind its last opening mark.
OPEN_TAG, OPEN_BRACKET, OPEN_ENTITY = r"(?s)^(/?|/?[a-zA-Z][^>]{0,80}|[a-zA-Z]+\s+[a-zA-Z-]+\s*=[^>]*)$", r"(?s)^/?[a-zA-Z]{0,12}(=[^\s\]]*)?$", r"^#?[a-zA-Z0-9]{0,8}$"
_TAG = r"<[^<>]{1,200}>|\[/?(b|i|u|s|quote|code|url|img|size|color|list)\b[^\]]{0,100}\]|&(amp;)*#?[a-zA-Z0-9]{1,8};"
_STOP = r"(?=[h\r\n.!?。！？؟।…:;\p{So}\x{1F000}-\x{1FAFF}])(?:https?://\S+|\r?\n|[.!?。！？؟।…]+(?=\s|$|[^\p{L}\p{N}])|[。！？؟।…]+|[:;]-?[)(/|DP](?=\s|$)|[\p{So}\x{1F000}-\x{1FAFF}]+)"
_WORD = r"\+\p{N}+|[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]|[\p{L}\p{M}\p{N}_]+(?:['’.,\-‑][\p{L}\p{M}\p{N}_]+)*|¶"


def _q(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _own(documents: str) -> str:
    """doc_id, source, body: the text without signature and without the dots that a store or feed adds where it cut it."""
    opens = " OR ".join(rf"contains(text, '\n{x}')" for x in SIGNATURE_OPENS)
    return rf"""
    SELECT doc_id, source, CASE WHEN right(own, 4) RLIKE r'\.{{3}}$' THEN rtrim('.', rtrim('\n', own))
      WHEN right(own, 2) RLIKE '…$' THEN rtrim('…', rtrim('\n', own)) ELSE own END AS body
    FROM (SELECT doc_id, source, IF({opens}, regexp_replace(text, {_q(SIGNATURE)}, ''), text) AS own
          FROM {documents} WHERE text IS NOT NULL AND trim(text) <> '')"""


def _words(own: str) -> str:
    """What is needed of a text (doc_id, source, body): its words (two stops in front, a stop wherever a sentence can end, digits as 0), its length
    in characters and bytes, and whether it ends with a blank, in a finished way, or in open markup."""
    stops = f"regexp_replace(regexp_replace(body, {_q(_TAG)}, ' '), {_q(_STOP)}, ' ¶ ')"
    words = rf"regexp_extract_all(regexp_replace(lower({stops}), r'\d+', '0'), {_q(_WORD)}, 0)"
    behind = lambda mark, pattern: f"(contains(body, '{mark}') AND substring_index(body, '{mark}', -1) RLIKE {_q(pattern)})"
    return rf"""
    SELECT doc_id, source, concat(array('¶', '¶'), {words}) AS w, length(body) AS n, octet_length(body) AS n_bytes,
      right(body, 3) RLIKE r'\S[ \t]\n?$' AS spaced,
      right(rtrim(body), 8) RLIKE {_q(FINISHED)} OR substring_index(substring_index(rtrim(body), ' ', -1), '\n', -1) RLIKE r'(?i)https?://\S+\s*$' AS finished,
      {behind("<", OPEN_TAG)} OR {behind("[", OPEN_BRACKET)} OR {behind("&", OPEN_ENTITY)} AS broken
    FROM ({own})"""


def truncated(documents: DataFrame, min_inside: int = 3, max_end_rate: float = 0.03, lean: float = 5.0) -> DataFrame:
    """Texts that stop before their end: doc_id, source, reason (markup, word, sentence, limit), context, the source's limit.

    ``context`` is the number of words that the counts were of, null for markup and limit. Rows with a null, empty or
    blank text are none; a null source is a source of its own. Every text is read whole, and the counts are of all
    texts. Repeated rows give repeated rows. Further columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text", "source")

    def view(sql: str, args: dict | None = None, **frames: DataFrame) -> DataFrame:
        sql = sql.replace("{", "{{").replace("}", "}}")
        for k in frames:
            sql = sql.replace("{{" + k + "}}", "{" + k + "}")
        return spark.sql(sql, args, **frames)

    words = cut(view(_words(_own("{docs}")), docs=docs))  # the patterns run once
    grams = cut(
        view(
            """
        SELECT a, b, c, count_if(NOT stops) AS inside, count_if(stops AND NOT blank) AS ended, count_if(blank) AS blank_ended
        FROM (SELECT a, b, c, d IS NULL OR d = '¶' AS stops, d IS NULL AND spaced AS blank
          FROM {words} LATERAL VIEW inline(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w)), slice(w, 4, size(w)))) AS a, b, c, d
          WHERE size(w) > 2 AND c IS NOT NULL)
        WHERE c <> '¶' OR blank OR NOT stops GROUP BY a, b, c""",
            words=words,
        )
    )
    last = cut(
        view(
            """
        SELECT doc_id, source, n, n_bytes, spaced, finished, broken,
          get(w, size(w) - 3) AS a, get(w, size(w) - 2) AS b, get(w, size(w) - 1) AS c
        FROM {words}""",
            words=words,
        )
    )
    asked = cut(view("SELECT DISTINCT a, b, c FROM {last} WHERE NOT broken AND (spaced OR (NOT finished AND c <> '¶'))", last=last))
    # shorter contexts, and what begins with the last word: of each context only the beginnings that are asked for
    stats = view(
        """
        WITH two AS (SELECT b, c, sum(inside) AS inside, sum(ended) AS ended, sum(blank_ended) AS blank_ended FROM {grams} GROUP BY b, c),
        one AS (SELECT c, sum(inside) AS inside, sum(ended) AS ended, sum(blank_ended) AS blank_ended FROM two GROUP BY c),
        beginnings AS (SELECT DISTINCT c FROM {asked}),
        longer1 AS (
          SELECT p AS c, sum(n) AS n FROM (
            SELECT inside + ended AS n, left(c, k) AS p
            FROM one LATERAL VIEW explode(sequence(1, length(c) - 1)) AS k WHERE length(c) > 1 AND inside + ended > 1)
          LEFT SEMI JOIN (SELECT c AS p FROM beginnings) y USING (p) GROUP BY p),
        longer2 AS (
          SELECT b, p AS c, sum(n) AS n FROM (
            SELECT b, inside + ended AS n, explode(transform(sequence(1, length(c) - 1), k -> left(c, k))) AS p
            FROM two LEFT SEMI JOIN (SELECT DISTINCT b FROM {asked}) x USING (b)
            WHERE length(c) > 1 AND inside + ended > 1) LEFT SEMI JOIN (SELECT DISTINCT b, c AS p FROM {asked}) y USING (b, p) GROUP BY b, p),
        longer3 AS (
          SELECT a, b, p AS c, sum(n) AS n FROM (
            SELECT a, b, inside + ended AS n, explode(transform(sequence(1, length(c) - 1), k -> left(c, k))) AS p
            FROM {grams} g LEFT SEMI JOIN (SELECT DISTINCT a, b FROM {asked}) x USING (a, b)
            WHERE length(c) > 1 AND inside + ended > 1) GROUP BY a, b, p)
        SELECT q.a, q.b, q.c,
          coalesce(g.inside, 0) AS in3, coalesce(g.ended, 0) AS end3, coalesce(g.blank_ended, 0) AS blank3,
          coalesce(two.inside, 0) AS in2, coalesce(two.ended, 0) AS end2, coalesce(two.blank_ended, 0) AS blank2,
          coalesce(one.inside, 0) AS in1, coalesce(one.ended, 0) AS end1, coalesce(one.blank_ended, 0) AS blank1,
          coalesce(l3.n, 0) AS more3, coalesce(l2.n, 0) AS more2, coalesce(l1.n, 0) AS more1
        FROM {asked} q
        LEFT JOIN {grams} g USING (a, b, c) LEFT JOIN two USING (b, c) LEFT JOIN one USING (c)
        LEFT JOIN longer3 l3 ON l3.a = q.a AND l3.b = q.b AND l3.c = q.c
        LEFT JOIN longer2 l2 ON l2.b = q.b AND l2.c = q.c
        LEFT JOIN longer1 l1 ON l1.c = q.c""",
        grams=grams,
        asked=asked,
    )
    # the text's own end is among the ends of its form; rare trigrams lean on their bigram, and that on the last word
    judged = view(
        """
        WITH s AS (SELECT l.*, s.* EXCEPT (a, b, c) FROM {last} l LEFT JOIN {stats} s ON l.a = s.a AND l.b = s.b AND l.c = s.c),
        e AS (SELECT *, greatest(IF(spaced, blank3, end3) - 1, 0) AS e3, greatest(IF(spaced, blank2, end2) - 1, 0) AS e2,
          greatest(IF(spaced, blank1, end1) - 1, 0) AS e1 FROM s),
        p1 AS (SELECT *, (e1 + 0.5) / (in1 + e1 + 1) AS r1 FROM e),
        p2 AS (SELECT *, (e2 + :lean * r1) / (in2 + e2 + :lean) AS r2 FROM p1),
        p3 AS (SELECT *, (e3 + :lean * r2) / (in3 + e3 + :lean) AS end_rate,
          CASE WHEN in3 + e3 + more3 >= 3 THEN struct(in3 + e3 AS whole, more3 AS longer, 3 AS context)
               WHEN in2 + e2 + more2 >= 3 THEN struct(in2 + e2 AS whole, more2 AS longer, 2 AS context)
               ELSE struct(in1 + e1 AS whole, more1 AS longer, 1 AS context) END AS k FROM p2),
        j AS (SELECT *, CASE
          WHEN broken THEN 'markup'
          WHEN finished AND NOT spaced THEN NULL
          WHEN c = '¶' AND NOT spaced THEN NULL
          WHEN in1 >= :min_inside AND end_rate < :max_end_rate THEN 'sentence'
          WHEN NOT spaced AND k.longer >= IF(in1 + e1 > 2, 5, 2) AND k.whole <= 0.1 * k.longer THEN 'word'
          END AS reason FROM p3)
        SELECT doc_id, source, n, n_bytes, finished OR coalesce(end_rate > 0.9, false) AS finished, reason,
          CASE WHEN reason IN ('sentence', 'word') THEN k.context END AS context FROM j""",
        dict(lean=lean, min_inside=min_inside, max_end_rate=max_end_rate),
        last=last,
        stats=stats,
    )
    judged = cut(judged)
    # a length is a source's limit if, with five texts of the source's own rate added, most of its texts are cut
    limits = view(
        """
        SELECT at.source, at.unit, at.len FROM (
          SELECT source, unit, len, count(reason) AS n_cut, count(*) AS n_all FROM (
            SELECT source, reason, stack(2, 'chars', n, 'bytes', n_bytes) AS (unit, len) FROM {judged})
          GROUP BY source, unit, len) at
        JOIN (SELECT source, avg(IF(reason IS NULL, 0, 1)) AS rate FROM {judged} GROUP BY source) mean ON at.source <=> mean.source
        WHERE (n_cut + 5 * rate) / (n_all + 5) > 0.5""",
        judged=judged,
    )
    limits = limits.toDF("source", "unit", "len")
    return view(
        """
        SELECT j.doc_id, j.source, coalesce(j.reason, 'limit') AS reason, j.context,
          CASE WHEN c.len IS NOT NULL THEN 'chars' WHEN b.len IS NOT NULL THEN 'bytes' END AS limit_unit, coalesce(c.len, b.len) AS limit_length
        FROM {judged} j
        LEFT JOIN (SELECT * FROM {limits} WHERE unit = 'chars') c ON j.source <=> c.source AND j.n = c.len
        LEFT JOIN (SELECT * FROM {limits} WHERE unit = 'bytes') b ON j.source <=> b.source AND j.n_bytes = b.len
        WHERE j.reason IS NOT NULL OR (NOT j.finished AND (c.len IS NOT NULL OR b.len IS NOT NULL))""",
        judged=judged,
        limits=limits,
    )


def truncation_by_source(documents: DataFrame, found: DataFrame) -> DataFrame:
    """For each source (null included) its texts, how many are cut, the share, and its field limit if it has one."""
    texts = documents.where("text is not null and trim(text) <> ''").groupBy("source").agg(F.count("*").alias("n_texts"))
    cuts = found.groupBy("source").agg(
        F.count("*").alias("n_truncated"),
        F.max("limit_unit").alias("limit_unit"),
        F.max("limit_length").alias("limit_length"),
    )
    same = texts["source"].eqNullSafe(cuts["source"])
    return texts.join(cuts, same, "left").select(
        texts["source"],
        "n_texts",
        F.coalesce("n_truncated", F.lit(0)).alias("n_truncated"),
        (F.coalesce("n_truncated", F.lit(0)) / F.col("n_texts")).alias("truncated_share"),
        "limit_unit",
        "limit_length",
    )
