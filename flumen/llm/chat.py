"""Chat formatting by quotation linking.

Messages quote earlier ones with ``>`` lines. Lines are parsed into a quote level and a body; a run of
lines of one level is a passage. Passages are normalised (A-Z lower-cased, white space collapsed) and
hashed. A quoted passage is joined to the first message of its conversation that wrote that passage:
its whole own text, a run of its unquoted lines, a paragraph of one (cut at blank lines), or any of its
own lines that follow each other, blank lines not counted. Where nobody wrote a quoted passage as a
whole, its paragraphs are joined instead and the latest original of these counts for it. Of the
originals found at a message's lowest linked quote level the latest is what the message replies to.
Threads come from pointer doubling over the replies, so a chain of n replies takes log2(n) rounds.

Lines that follow each other are hashed only where one begins like a quoted passage of the conversation
and for the numbers of lines of such passages, which loses no original.

The result has a row for each message: its thread (the turn of its root), depth, what it replies to,
its position in the reply-ordered conversation (threads in the order of their roots, a thread in the
order of its turns, so that a reply always follows what it answers) and its text without quotes.

Built-in expressions only. Passages are made only in conversations that have a quote. Positions come from a
range partitioning of all messages in that order, so that no task takes a whole conversation.

Null texts count as empty, and a message of any length is read whole. Rows with the same conversation and
turn all stay, next to each other, ordered by role and a digest of their text. A null conversation is one
like any other. Messages without a turn have no place among the others: they neither quote nor are
quoted, stay apart from all turns and come first. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, stored

LEAST_QUOTE = 2  # characters of a normalised passage that can be linked
_QUOTES = r"text RLIKE '(^|\n)[ \t]*>'"


def number_messages(messages: DataFrame) -> DataFrame:
    """conv (the conversation, null ones alike), row, turn, role, text and whether a line is quoted."""
    rows = messages.selectExpr("named_struct('id', conv_id) AS conv", "turn", "role", "coalesce(text, '') AS text")
    return rows.withColumn("row", F.monotonically_increasing_id()).withColumn("quotes", F.expr(_QUOTES))


def parse_messages(rows: DataFrame) -> DataFrame:
    """``rows`` with body (own text), own passages (normalised), own lines (normalised, without blank ones) and quoted passages (level, normalised lines)."""
    kept = [c for c in rows.columns if c != "text"]
    rows = rows.selectExpr(
        "*",
        r"""transform(split(text, '\n'), line -> named_struct(
              'level', regexp_count(regexp_extract(line, '^((?:[ \\t]*>)*)', 1), '>'),
              'body', IF(line RLIKE '^[ \\t]*>', regexp_replace(line, '^(?:[ \\t]*>)+[ \\t]?', ''), line))) AS raw""",
    )
    flat = lambda text: rf"trim(regexp_replace(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\r\\f\\n]+', ' '))"
    rows = rows.selectExpr(*kept, f"transform(raw, x -> named_struct('level', x.level, 'body', x.body, 'flat', {flat('x.body')})) AS lines")
    # where a run of lines of one level starts, and the line after the last
    rows = rows.selectExpr(
        "*", "concat(filter(transform(lines, (x, i) -> IF(i = 0 OR lines[greatest(i, 1) - 1].level <> x.level, i, -1)), i -> i >= 0), array(size(lines))) AS cuts"
    )
    # the lines of a run stay apart, so that blank ones still show where its paragraphs end
    rows = rows.selectExpr(
        "*",
        f"""filter(transform(slice(cuts, 1, size(cuts) - 1), (c, k) -> named_struct('level', lines[c].level,
              'text', trim(BOTH '\\n' FROM array_join(transform(slice(lines, c + 1, cuts[k + 1] - c), x -> x.flat), '\\n')))),
              p -> length({_close("p.text")}) >= {LEAST_QUOTE}) AS runs""",
        r"trim(array_join(transform(filter(lines, x -> x.level = 0), x -> x.body), '\n')) AS body",
        "filter(transform(filter(lines, x -> x.level = 0), x -> x.flat), x -> x <> '') AS own_lines",
    )
    return rows.selectExpr(
        *kept,
        "body",
        "filter(runs, p -> p.level > 0) AS quoted",
        f"""filter(array_distinct(concat(array(array_join(own_lines, ' ')), transform(filter(runs, p -> p.level = 0), p -> {_one_line(_close("p.text"))}),
              transform(flatten(transform(filter(runs, p -> p.level = 0), p -> {_paragraphs("p.text")})), t -> {_one_line("t")}), own_lines)),
              p -> length(p) >= {LEAST_QUOTE}) AS own""",
        "own_lines",
    )


def _close(text: str) -> str:
    """Lines without the blank ones."""
    return rf"regexp_replace({text}, '\n+', '\n')"


def _paragraphs(text: str) -> str:
    return rf"split({text}, '\n\n+')"


def _one_line(text: str) -> str:
    return rf"translate({text}, '\n', ' ')"


def find_replies(parsed: DataFrame, folder: str) -> DataFrame:
    """(conv, turn, parent): the turn that a message replies to."""
    # each quoted passage as a whole (part 0), and its paragraphs if it has several (part 1)
    quotes = (
        parsed.where(F.size("quoted") > 0)
        .select("conv", "turn", F.explode("quoted").alias("q"))
        .selectExpr("conv", "turn", "q.level", f"{_close('q.text')} AS whole", f"{_paragraphs('q.text')} AS parts")
        .selectExpr(
            "conv",
            "turn",
            "level",
            f"sha2({_one_line('whole')}, 256) AS passage",
            f"""explode(concat(array(named_struct('part', 0, 'text', whole)), IF(size(parts) > 1,
                  transform(filter(parts, t -> length(t) >= {LEAST_QUOTE}), t -> named_struct('part', 1, 'text', t)), array()))) AS q""",
        )
        .selectExpr("conv", "turn", "level", "passage", "q.part", f"sha2({_one_line('q.text')}, 256) AS h", r"split(q.text, '\n') AS lines")
    )
    wanted = quotes.select("conv", "h").distinct()
    # the first message that wrote a quoted passage: one row for each passage, written so that the join of
    # a passage that many quote can be split
    originals = stored(
        parsed.select("conv", "turn", F.explode("own").alias("p"))
        .select("conv", "turn", F.sha2("p", 256).alias("h"))
        .union(find_windows(parsed, quotes, folder))
        .groupBy("conv", "h")
        .agg(F.min("turn").alias("first"))
        .join(wanted, ["conv", "h"], "left_semi"),
        folder,
        "originals",
    )
    linked = quotes.join(originals, ["conv", "h"]).where("first < turn")
    # of a passage the whole goes before its parts
    passages = linked.groupBy("conv", "turn", "level", "passage").agg(F.min(F.struct("part", (-F.col("first")).alias("back"))).alias("m"))
    return passages.groupBy("conv", "turn").agg(F.min(F.struct("level", "m.back")).alias("m")).selectExpr("conv", "turn", "-m.back AS parent")


def find_windows(parsed: DataFrame, quotes: DataFrame, folder: str) -> DataFrame:
    """(conv, turn, h) of own lines that follow each other, where they begin like a quoted passage of several lines and are as many."""
    wanted = quotes.where(F.size("lines") > 1).selectExpr("conv", "xxhash64(lines[0]) AS s", "size(lines) AS n").groupBy("conv", "s").agg(F.collect_set("n").alias("ns"))
    wanted = stored(wanted, folder, "beginnings")
    several = parsed.where(F.size("own_lines") > 1)
    starts = (
        several.select("conv", "turn", F.posexplode("own_lines").alias("at", "line"))
        .selectExpr("conv", "turn", "at", "xxhash64(line) AS s")
        .join(wanted, ["conv", "s"])
        .groupBy("conv", "turn")
        .agg(F.collect_set(F.struct("at", "ns")).alias("starts"))
    )
    # rows of one turn try each other's starts too: what they give is their own text all the same
    return (
        several.select("conv", "turn", "own_lines")
        .join(starts, ["conv", "turn"])
        .selectExpr(
            "conv",
            "turn",
            """explode(array_distinct(flatten(transform(starts, x -> transform(filter(x.ns, n -> x.at + n <= size(own_lines)),
                 n -> sha2(array_join(slice(own_lines, x.at + 1, n), ' '), 256)))))) AS h""",
        )
    )


def find_threads(replies: DataFrame, folder: str) -> DataFrame:
    """(conv, turn, parent, root, depth) of every message that replies."""
    at = stored(replies.selectExpr("conv", "turn", "parent", "parent AS root", "1L AS depth"), folder, "threads_0")
    k = 0
    while True:
        up = at.selectExpr("conv", "turn AS root", "root AS next", "depth AS more")
        k += 1
        joined = at.join(up, ["conv", "root"], "left")
        at = stored(joined.selectExpr("conv", "turn", "parent", "coalesce(next, root) AS root", "depth + coalesce(more, 0L) AS depth", "next IS NOT NULL AS moved"), folder, f"threads_{k}")
        if not at.where("moved").limit(1).count():
            return at.drop("moved")
        at = at.drop("moved")


def link_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, reply_to, root, depth, position, n_quotes and body of every message."""
    spark = messages.sparkSession
    folder = shared_folder(spark)
    rows = stored(number_messages(messages), folder, "messages")
    # passages are needed of conversations with a quote only
    quoting = stored(rows.where("quotes AND turn IS NOT NULL").select("conv").distinct(), folder, "quoting")
    parsed = stored(parse_messages(rows.where("turn IS NOT NULL").join(quoting, "conv", "left_semi")), folder, "parsed")
    threads = find_threads(find_replies(parsed, folder), folder)
    bodies = rows.where("NOT quotes").selectExpr("conv", "row", "turn", "role", "trim(text) AS body", "0L AS n_quotes")
    quotes = parse_messages(rows.where("quotes")).selectExpr("conv", "row", "turn", "role", "body", "CAST(size(quoted) AS BIGINT) AS n_quotes")
    rows = (
        bodies.unionByName(quotes)
        .join(threads, ["conv", "turn"], "left")
        .selectExpr("conv", "row", "turn", "role", "parent AS reply_to", "coalesce(root, turn) AS root", "coalesce(depth, 0L) AS depth", "n_quotes", "body")
    )
    # in order: a conversation may go through several parts, and counts on from the parts before
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv", "root", "turn", "role", "digest", "row"]
    rows = stored(rows.withColumn("digest", F.md5("body")).repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), folder, "ordered")
    counts = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(counts.select("conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")), folder, "starts")
    ranked = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv", "part").orderBy("root", "turn", "role", "digest", "row")))
    return ranked.join(starts, ["conv", "part"]).selectExpr(
        "conv.id AS conv_id", "turn", "role", "reply_to", "root", "depth", "CAST(start + at - 1 AS BIGINT) AS position", "n_quotes", "body"
    )


#: The same by DuckDB; replies are followed by recursion.
ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT *, list_transform(string_split(text, chr(10)), lambda x: struct_pack(
        level := len(regexp_extract_all(regexp_extract(x, '^(?:[ \t]*>)*'), '>')), body := regexp_replace(x, '^(?:[ \t]*>)+[ \t]?', ''))) AS lines FROM m),
c AS (SELECT *, list_concat(list_filter(range(len(lines)), lambda i: i = 0 OR lines[i + 1].level <> lines[i].level), [len(lines)]) AS cuts,
        trim(array_to_string(list_transform(list_filter(lines, lambda x: x.level = 0), lambda x: x.body), chr(10)), ' ') AS body FROM l),
r AS (SELECT *, list_filter(list_transform(range(1, len(cuts)), lambda k: struct_pack(level := lines[cuts[k] + 1].level,
        passage := trim(regexp_replace(translate(array_to_string(list_transform(lines[cuts[k] + 1:cuts[k + 1]], lambda x: x.body), chr(10)),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\f\n]+', ' ', 'g'), ' '))), lambda p: length(p.passage) >= 2) AS runs FROM c),
q AS (SELECT conv_id, turn, u.level AS level, u.passage AS passage FROM (SELECT conv_id, turn, unnest(list_filter(runs, lambda p: p.level > 0)) AS u FROM r)),
o AS (SELECT conv_id, passage, min(turn) AS first FROM (
        SELECT conv_id, turn, unnest(list_concat([body], list_transform(list_filter(runs, lambda p: p.level = 0), lambda p: p.passage),
          list_transform(list_filter(lines, lambda x: x.level = 0), lambda x: x.body))) AS raw,
          trim(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\f\n]+', ' ', 'g'), ' ') AS passage FROM r)
      WHERE length(passage) >= 2 AND turn IS NOT NULL GROUP BY ALL),
e AS (SELECT conv_id, turn, arg_max(first, first) AS parent FROM (
        SELECT q.conv_id, q.turn, level, first, min(level) OVER (PARTITION BY q.conv_id, q.turn) AS least FROM q JOIN o ON q.conv_id IS NOT DISTINCT FROM o.conv_id AND q.passage = o.passage WHERE first < q.turn)
      WHERE level = least GROUP BY ALL),
t AS (SELECT conv_id, turn, parent, parent AS root, 1 AS depth FROM e
      UNION ALL SELECT t.conv_id, t.turn, t.parent, e.parent, t.depth + 1 FROM t JOIN e ON e.conv_id IS NOT DISTINCT FROM t.conv_id AND e.turn = t.root),
d AS (SELECT conv_id, turn, parent, min(root) AS root, max(depth) AS depth FROM t GROUP BY ALL),
f AS (SELECT r.conv_id, r.turn, role, d.parent AS reply_to, coalesce(d.root, r.turn) AS root, coalesce(d.depth, 0) AS depth,
        len(list_filter(runs, lambda p: p.level > 0)) AS n_quotes, body FROM r LEFT JOIN d ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND d.turn = r.turn)
SELECT conv_id, turn, role, reply_to, root, CAST(depth AS BIGINT) AS depth, CAST(n_quotes AS BIGINT) AS n_quotes, body,
       row_number() OVER (PARTITION BY conv_id ORDER BY root NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, md5(body)) - 1 AS position FROM f"""
