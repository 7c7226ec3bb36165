"""Requirement documents: F19, F21, F23, F24, F26-F30, R23, R25, R30-R36, X2, X4, X10-X14, X20-X22, X27, X29, X34, S9, A27 stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import cues, structure
from tidemark.functions import lexicon as lx
from tidemark.functions import text as tx
from tidemark.operators import matching, repair, replies, units
from tidemark.operators import ranking as rk
from tidemark.plans.text import HEADS, _has, content, norm, toks
from tidemark.registry import ORACLE, query
from tidemark.tables import BRIEF_LINES_SQL, TIMELINE, asks, brief_lines, load, timeline

LINES = "ln AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


@query("f19_labels", "SELECT item_id, array_to_string(list_slice(string_split(regexp_replace(trim(text), '^(The|That|And|In|Of) ', ''), ' '), 1, 8), ' ') AS label FROM benchmark")
def f19(spark: SparkSession, d: str) -> DataFrame:
    """A label: no directive preamble, eight words at most."""
    t = F.regexp_replace(F.trim("text"), "^(The|That|And|In|Of) ", "")
    return load(spark, d, "benchmark").select("item_id", F.array_join(F.slice(F.split(t, " "), 1, 8), " ").alias("label"))


HEAD = "regexp_matches(line, '^#+ ') OR (len(string_split(trim(line), ' ')) <= 4 AND trim(line) <> '' AND NOT regexp_matches(line, '[.!?]$'))"


def is_heading(line: str = "line"):
    c = F.col(line)
    return c.rlike("^#+ ") | ((F.size(F.split(F.trim(c), " ")) <= 4) & (F.trim(c) != "") & ~c.rlike("[.!?]$"))


@query("f21_headings", f"WITH {HEADS} SELECT doc, pos, p AS line, head FROM hl")
def f21(spark: SparkSession, d: str) -> DataFrame:
    """Which lines of a document are headings, marked or plain."""
    l = brief_lines(spark, d).filter(~F.col("line").rlike(lx.PAGE_RULE)).withColumn("p", F.trim(F.regexp_replace("line", "^#+ ", "")))
    ref = F.col("p").rlike("(?i)" + lx.REFERENCE) | F.col("p").rlike(lx.ONLY_LINK)
    return l.select("doc", "pos", F.col("p").alias("line"), (F.col("line").rlike("^#{1,6} ") | (~ref & structure.plain_heading(F.col("p")))).alias("head"))


@query("f23_section_items", f"WITH {LINES}, f AS (SELECT *, CASE WHEN pos = 0 OR regexp_matches(line, '^[A-Z]') THEN 1 ELSE 0 END AS st FROM ln), i AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS item FROM f) SELECT doc_id, CAST(item AS BIGINT) AS item, min(pos) AS pos, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM i GROUP BY doc_id, item")
def f23(spark: SparkSession, d: str) -> DataFrame:
    """Items: a line that starts one, with the lines that continue it."""
    f = lines(spark, d).withColumn("st", ((F.col("pos") == 0) | F.col("line").rlike("^[A-Z]")).cast("int"))
    i = f.withColumn("item", F.sum("st").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("doc_id", "item").agg(F.min("pos").alias("pos"), F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


@query("f24_quoted_examples", f"""WITH {BRIEF_LINES_SQL} SELECT doc, pos, regexp_matches(line, '(?i){lx.DESCRIBED}') AND regexp_matches(line, '(?i){lx.REPORTED}') AND NOT regexp_matches(line, '(?i){lx.OBLIGED.replace("'", "''")}') AND NOT regexp_matches(line, '(?i){lx.IMPERATIVE_START}') AS described, length(line) > 8 AND regexp_matches(line, '^["“”''‘’]') AS quoted FROM bl""")
def f24(spark: SparkSession, d: str) -> DataFrame:
    """Lines that describe an example, and lines that are to be said."""
    return brief_lines(spark, d).select("doc", "pos", structure.descriptive(F.col("line")).alias("described"), structure.quoted_example(F.col("line")).alias("quoted"))


@query("f26_approved_claims", f"WITH {LINES} SELECT doc_id, pos, array_to_string(regexp_extract_all(line, '[0-9]+'), ',') AS numbers FROM ln WHERE regexp_matches(line, '[0-9]')")
def f26(spark: SparkSession, d: str) -> DataFrame:
    """Lines that claim a number, with their numbers."""
    return lines(spark, d).filter(F.col("line").rlike("[0-9]")).select("doc_id", "pos", F.array_join(tx.digit_runs(F.col("line")), ",").alias("numbers"))


@query("f27_units", r"WITH u AS (SELECT item_id, unnest(regexp_split_to_array(replace(text, chr(10), ' '), '[.;] ?')) AS unit FROM benchmark) SELECT item_id, trim(unit) AS unit, count(*) AS n FROM u WHERE trim(unit) <> '' GROUP BY ALL")
def f27(spark: SparkSession, d: str) -> DataFrame:
    """Sentences and clauses of an item, equal ones once."""
    u = load(spark, d, "benchmark").select("item_id", F.explode(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), "[.;] ?")).alias("unit"))
    return u.filter(F.trim("unit") != "").groupBy("item_id", F.trim("unit").alias("unit")).agg(F.count("*").alias("n"))


@query("f27_brief_units")
def f27_units(spark: SparkSession, d: str) -> DataFrame:
    """What each document asks for, one thing a row: items into sentences, sentences into asks (F27, by a table function)."""
    return units.brief_units(structure.sections(brief_lines(spark, d), "doc", "pos", "line"))


@query(
    "f23_items",
    rf"""WITH {HEADS}, s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM hl),
    l AS (SELECT doc, section, pos, p, regexp_matches(p, '{units.TITLE}') AS title, regexp_matches(p, '(?i){lx.BULLET}') AS bullet FROM s WHERE NOT head AND NOT (regexp_matches(p, '(?i){lx.REFERENCE}') OR regexp_matches(p, '{lx.ONLY_LINK}'))),
    w AS (SELECT *, bool_or(title) OVER (PARTITION BY doc, section) AS numbered, bool_or(bullet) OVER (PARTITION BY doc, section) AS bulleted, coalesce(lag(bullet) OVER (PARTITION BY doc, section ORDER BY pos), true) AS after FROM l),
    i AS (SELECT *, sum(CASE WHEN numbered THEN title WHEN bulleted THEN bullet OR after ELSE true END::INT) OVER (PARTITION BY doc, section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isle FROM w),
    b AS (SELECT *, trim(CASE WHEN title THEN regexp_extract(p, '{units.TITLE}', 2) ELSE regexp_replace(p, '(?i){lx.BULLET}', '') END) AS bare FROM i WHERE isle > 0),
    t AS (SELECT doc, section, isle, trim(regexp_replace(coalesce(string_agg(bare, ' ' ORDER BY pos) FILTER (bare <> ''), ''), '\s+', ' ', 'g')) AS text FROM b GROUP BY ALL)
    SELECT doc, CAST(section AS BIGINT) AS section, row_number() OVER (PARTITION BY doc, section ORDER BY isle) - 1 AS item, text FROM t WHERE length(text) >= 3""",
)
def f23_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of each section: numbered titles with what follows them, bullets, or lines."""
    return units.section_items(structure.sections(brief_lines(spark, d), "doc", "pos", "line")).select("doc", "section", "item", "text")


@query("f28_match_hints")
def f28(spark: SparkSession, d: str) -> DataFrame:
    """Hints of each ask: content tokens that are no verbs of asking, synonyms of its topics, quotations; twelve at most, in that order."""
    return asks(spark, d).select("id", "text", F.array_join(cues.match_hints(F.col("text")), ",").alias("hints"))


@query("f30_angle_names", f"WITH {LINES}, h AS (SELECT doc_id, trim(line) AS name, pos FROM ln WHERE {HEAD}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM h) SELECT doc_id, string_agg(name, '|' ORDER BY pos) AS names FROM r WHERE rn <= 8 GROUP BY doc_id")
def f30(spark: SparkSession, d: str) -> DataFrame:
    """Names that headings give, eight at most."""
    h = lines(spark, d).filter(is_heading()).select("doc_id", "pos", F.trim("line").alias("name"))
    g = h.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "name"))), 1, 8).alias("l"))
    return g.select("doc_id", F.array_join(F.col("l.name"), "|").alias("names"))


@query("r23_preview_check", f"WITH {TIMELINE}, h AS (SELECT video, arg_max(event_id, (k, -event_id)) AS best, max(k) AS score, min(t0) FILTER (k >= 90) AS late FROM tl WHERE modality IN ('click', 'view') GROUP BY video) SELECT video, best, CASE WHEN score < 50 THEN 'UNCERTAIN' WHEN score < 90 THEN 'FAIL' WHEN late > 864000000 THEN 'PARTIAL' ELSE 'PASS' END AS status FROM h")
def r23(spark: SparkSession, d: str) -> DataFrame:
    """The best hit in the modes; a late one is partial."""
    h = timeline(spark, d).filter("modality in ('click', 'view')").groupBy("video").agg(F.max_by("event_id", F.struct("k", -F.col("event_id"))).alias("best"), F.max("k").alias("score"), F.min(F.when(F.col("k") >= 90, F.col("t0"))).alias("at"))
    return h.select("video", "best", F.when(F.col("score") < 50, "UNCERTAIN").when(F.col("score") < 90, "FAIL").when(F.col("at") > 864_000_000, "PARTIAL").otherwise("PASS").alias("status"))


@query("r25_standing_topics", f"WITH v AS (SELECT DISTINCT unnest({toks('text')}) AS t FROM documents), p AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS t FROM (SELECT DISTINCT p_name || ' the' AS p_name FROM part)) SELECT p_name, count(v.t) * 2 >= count(*) AS seen FROM p LEFT JOIN v USING (t) GROUP BY p_name")
def r25(spark: SparkSession, d: str) -> DataFrame:
    """Topics at least half of whose tokens the corpus has."""
    v = load(spark, d, "documents").select(F.explode(tx.tokens(F.col("text"))).alias("t")).distinct().withColumn("there", F.lit(1))
    p = load(spark, d, "part").select(F.concat("p_name", F.lit(" the")).alias("p_name")).distinct().select("p_name", F.explode(F.split("p_name", " ")).alias("t"))
    return p.join(v, "t", "left").groupBy("p_name").agg((F.count("there") * 2 >= F.count("*")).alias("seen"))


@query("r30_ungroup", f"WITH {LINES}, c AS (SELECT DISTINCT doc_id FROM ln WHERE regexp_matches(lower(line), 'rights reserved|license')) SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN source END AS grp FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id")
def r30(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a compliance line leave their group."""
    c = F.exists(F.split("text", "\n"), lambda x: F.lower(x).rlike("rights reserved|license"))
    return load(spark, d, "documents").select("doc_id", F.when(~c, F.col("source")).alias("grp"))


def _told(k: str) -> str:
    return _has([*lx.SECTION_KINDS.get(k, []), *lx.SECTION_FIRST.get(k, [])], "heading")


_PLAIN = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9 ]+', ' ', 'g'))"


@query(
    "r30_ungrouped",
    f"""WITH s AS ({ORACLE["f22_sections"]}), l AS (SELECT doc, section, heading, kind, unnest(string_split(lines, '|')) AS line, generate_subscripts(string_split(lines, '|'), 1) - 1 AS nr FROM s WHERE lines <> ''),
    r AS (SELECT doc, doc * 10000 + section * 100 + nr AS id, CASE WHEN (doc + nr) % 6 = 1 THEN line || ' #ad' ELSE line END AS text, CASE WHEN doc % 3 = 0 THEN upper(line) WHEN doc % 3 = 1 THEN substr(line, 1, 18) END AS span,
      CASE WHEN (doc + section) % 4 > 0 THEN 'g' || section END AS choice, CASE WHEN doc % 5 = 0 THEN 'all_of' ELSE 'one_of' END AS choice_mode, CASE WHEN doc % 11 = 0 THEN 'Legal notes' ELSE heading END AS label FROM l),
    x AS (SELECT doc, CASE WHEN kind = 'alternatives' THEN 'alt' ELSE 'fixed' END AS side, {_PLAIN.format("line")} AS line FROM l WHERE kind = 'alternatives' OR (kind = 'requirements' AND {_told("requirements")}) OR (kind = 'claims' AND {_told("claims")})),
    j AS (SELECT *, choice IS NOT NULL AND ({_has(lx.COMPLIANCE, "text || ' ' || coalesce(span, '')")} OR {_has(lx.COMPLIANCE_SHAPE, "ltrim(text || ' ' || coalesce(span, ''))")} OR regexp_matches(label, '(?i){lx.COMPLIANCE_SECTION}')) AS legal FROM r),
    n AS (SELECT doc, id, unnest([{_PLAIN.format("span")}, {_PLAIN.format("text")}]) AS n FROM j WHERE NOT legal AND choice IS NOT NULL AND choice_mode IN ('one_of', 'any_of')),
    p AS (SELECT id, bool_or(side = 'fixed') AND NOT bool_or(side = 'alt') AS moved FROM n JOIN x USING (doc) WHERE length(n) >= 4 AND length(line) >= 4 AND (n = line OR (length(n) >= 12 AND (contains(line, n) OR contains(n, line)))) GROUP BY id)
    SELECT id, CASE WHEN NOT legal AND NOT coalesce(moved, false) THEN choice END AS choice, CASE WHEN legal OR coalesce(moved, false) THEN 'all_of' ELSE choice_mode END AS choice_mode,
      CASE WHEN legal THEN 'UNGROUPED_COMPLIANCE_LINE:' || choice WHEN moved THEN 'UNGROUPED_BY_STRUCTURE:' || choice END AS flag FROM j LEFT JOIN p USING (id)""",
)
def r30_ungrouped(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as requirements in choices; compliance lines and lines of fixed sections leave theirs."""
    s = structure.sections(brief_lines(spark, d), "doc", "pos", "line")
    at, line, doc = F.col("at"), F.col("line"), F.col("doc")
    r = s.select("doc", "section", "heading", F.posexplode("lines").alias("at", "line")).select(
        "doc", (doc * 10000 + F.col("section") * 100 + at).alias("id"), F.when((doc + at) % 6 == 1, F.concat(line, F.lit(" #ad"))).otherwise(line).alias("text"),
        F.when(doc % 3 == 0, F.upper(line)).when(doc % 3 == 1, F.substring(line, 1, 18)).alias("span"), F.when((doc + F.col("section")) % 4 > 0, F.concat(F.lit("g"), F.col("section").cast("string"))).alias("choice"),
        F.when(doc % 5 == 0, "all_of").otherwise("one_of").alias("choice_mode"), F.when(doc % 11 == 0, "Legal notes").otherwise(F.col("heading")).alias("label"),
    )
    return units.ungrouped(r, s).select("id", "choice", "choice_mode", "flag")


@query("r31_claims_to_requirements", "SELECT item_id, 'claim' AS origin FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text)) UNION ALL SELECT doc_id, 'document' FROM labels WHERE quality = 1")
def r31(spark: SparkSession, d: str) -> DataFrame:
    """A requirement for each claim that nothing covers, beside those there are."""
    b = load(spark, d, "benchmark").select("item_id", F.col("text").alias("item"))
    covered = matching.contained(b, "item", load(spark, d, "documents").select("doc_id", "text"), "text", "doc_id").select("item_id").distinct()
    own = load(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("item_id"), F.lit("document").alias("origin"))
    return b.select("item_id").join(covered, "item_id", "left_anti").withColumn("origin", F.lit("claim")).unionByName(own)


@query("r32_fidelity_rule", "SELECT source, count(*) AS n, bool_or(regexp_matches(text, '[0-9]')) AND NOT bool_or(regexp_matches(lower(text), 'figures must match')) AS add_rule FROM documents GROUP BY source")
def r32(spark: SparkSession, d: str) -> DataFrame:
    """One rule is added where a number is claimed and no rule covers it."""
    return load(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), (F.bool_or(F.col("text").rlike("[0-9]")) & ~F.bool_or(F.lower("text").rlike("figures must match"))).alias("add_rule"))


INTENTS = [("en", "rights and license"), ("de", "zz qqq"), ("fr", "les des")]


@query("r34_group_intents", f"WITH {norm('c', 'SELECT lang, text AS x FROM documents')}, o AS (SELECT lang, list_distinct(flatten(list({content('norm')}))) AS body FROM c GROUP BY lang), n AS (SELECT * FROM (VALUES " + ", ".join(map(str, INTENTS)) + f") v(lang, intent)) SELECT lang, intent, len(list_intersect(body, {content('intent')})) = 0 AS flagged FROM o JOIN n USING (lang)")
def r34(spark: SparkSession, d: str) -> DataFrame:
    """Intents that share no content word with any option of their group."""
    n = spark.createDataFrame(INTENTS, "lang string, intent string")
    words = n.select("lang", "intent", F.explode_outer(tx.content_tokens(F.col("intent"))).alias("t"))
    body = load(spark, d, "documents").select("lang", F.explode(tx.content_tokens(F.col("text"))).alias("t")).distinct().withColumn("there", F.lit(1))
    return F.broadcast(words).join(body, ["lang", "t"], "left").groupBy("lang", "intent").agg((F.count("there") == 0).alias("flagged"))


@query("r35_requirement_repair", "SELECT o_orderkey, coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), '5-LOW') AS priority, array_to_string(list_filter([CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'PRIORITY_DEFAULTED' END, CASE WHEN o_totalprice < 1000 THEN 'PRICE_RAISED' END, CASE WHEN o_orderstatus = 'P' THEN 'STATUS_OPEN' END], lambda x: x IS NOT NULL), ',') AS flags, greatest(o_totalprice, 1000) AS price FROM orders")
def r35(spark: SparkSession, d: str) -> DataFrame:
    """Repairs with a trail of flags."""
    flags = F.array_compact(F.array(F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "PRIORITY_DEFAULTED"), F.when(F.col("o_totalprice") < 1000, "PRICE_RAISED"), F.when(F.col("o_orderstatus") == "P", "STATUS_OPEN")))
    return load(spark, d, "orders").select("o_orderkey", F.coalesce(F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")), F.lit("5-LOW")).alias("priority"), F.array_join(flags, ",").alias("flags"), F.greatest("o_totalprice", F.lit(1000.0)).alias("price"))


@query("r35_repaired_requirements")
def r35_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Asks as a model might have returned them, with fields that are wrong, missing or made up by the key, repaired with a trail."""
    t, at, none = F.col("text"), F.col("id"), F.lit(None)
    pick = lambda *values: F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(F.xxhash64("id", F.lit(len(values)), F.lit(str(values))), F.lit(len(values))).cast("int"))
    a = asks(spark, d).select(
        "id", F.expr("id div 40").alias("doc"), t, pick("visual", "Speech", "hook", "vsual", None).alias("type"), pick("visual_only", "speech_only", "any", "eyes", None).alias("mode"), pick("required", "forbidden", "maybe").alias("polarity"),
        pick("high", "low", "urgent", None).alias("priority"), (at % 3 == 0).alias("checkable"), F.when(at % 4 == 1, at % 900 - 20).cast("double").alias("deadline"), F.when(at % 6 == 2, at % 31).cast("double").alias("window_start"), F.when(at % 6 == 2, at % 29).cast("double").alias("window_end"),
        pick("duration - 5", "duration - 15", "duration ^ 2", None, None).alias("start_expr"), pick("duration", "len(", None).alias("end_expr"), F.array(pick("cure", "magic", " ")).alias("classes"), F.when(at % 5 > 0, F.array(F.lit("jar"))).alias("hints"), none.cast("array<string>").alias("criteria"),
        F.when(at % 7 == 3, "dance on the moon with penguins").when(at % 7 > 0, t).alias("span"), (at % 11 / 8).alias("confidence"), F.when(at % 9 == 0, "c").alias("choice"), pick("all_of", "one_of", "two_of").alias("choice_mode"),
    )
    documents = asks(spark, d).filter("id % 8 > 0").groupBy(F.expr("id div 40").alias("doc")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", "text")))["text"], " ").alias("text"))
    claims = asks(spark, d).filter("id % 10 = 1").select(F.expr("id div 40").alias("doc"), F.col("id").alias("pos"), t.alias("claim"))
    r = repair.repair_requirements(a, documents, claims)
    return r.select(*(F.array_join(c, ",").alias(c) if c in ("classes", "hints", "criteria") else F.col(c) for c in r.columns if c != "flags"), F.array_join("flags", "|").alias("flags"))


@query("r36_event_normalise", f"WITH {TIMELINE}, o AS (SELECT *, min(k) OVER (PARTITION BY video) >= 1 AS one_based, count(*) OVER (PARTITION BY video) AS n FROM tl), x AS (SELECT event_id, video, least(greatest(CASE WHEN one_based THEN k - 1 ELSE k END, 0), n - 1) AS a, least(greatest(CASE WHEN one_based THEN k - 1 ELSE k END + CAST(value AS INTEGER) % 7 - 3, 0), n - 1) AS b FROM o) SELECT event_id, least(a, b) AS first_idx, greatest(a, b) AS last_idx FROM x")
def r36(spark: SparkSession, d: str) -> DataFrame:
    """Frame ranges: 1-based numbering found out by partition, clamped, swapped if reversed."""
    w = Window.partitionBy("video")
    o = timeline(spark, d).withColumns({"lo": F.min("k").over(w), "n": F.count("*").over(w)})
    k = F.when(F.col("lo") >= 1, F.col("k") - 1).otherwise(F.col("k"))
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.col("n") - 1)
    x = o.withColumns({"a": clamp(k), "b": clamp(k + F.rint("value").cast("int") % 7 - 3)})
    return x.select("event_id", F.least("a", "b").alias("first_idx"), F.greatest("a", "b").alias("last_idx"))


@query("x2_approximate_flag", f"WITH {TIMELINE}, ap AS (SELECT DISTINCT video, k FROM tl WHERE value < 2 UNION SELECT DISTINCT video, k FROM tl WHERE modality = 'error' AND value > 200) SELECT event_id, EXISTS (SELECT 1 FROM ap WHERE ap.video = tl.video AND ap.k IN (tl.k, tl.k + 1)) AS approx FROM tl")
def x2(spark: SparkSession, d: str) -> DataFrame:
    """A record is approximate if one of its frames is, in either source."""
    t = timeline(spark, d)
    ap = t.filter("value < 2").select("video", "k").union(t.filter("modality = 'error' and value > 200").select("video", "k")).groupBy("video").agg(F.collect_set("k").alias("ap"))
    return t.join(ap, "video", "left").select("event_id", F.coalesce(F.arrays_overlap(F.array("k", F.col("k") + 1), "ap"), F.lit(False)).alias("approx"))


@query("x4_latest_lookup", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS newest, max(lpad(CAST(event_id AS VARCHAR), 9, '0')) AS last_name FROM events WHERE event_type <> 'error' GROUP BY user_id")
def x4(spark: SparkSession, d: str) -> DataFrame:
    """The newest artifact, and the last by name."""
    return load(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"), F.max(F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("last_name"))


@query("x10_scene_count", f"WITH {TIMELINE} SELECT video, coalesce(nullif(count(*) FILTER (modality = 'signup' AND k > 50), 0), nullif(count(DISTINCT k) - 1, 0), count(*)) AS scenes FROM tl GROUP BY video")
def x10(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0)
    return timeline(spark, d).groupBy("video").agg(F.coalesce(F.nullif(F.count_if((F.col("modality") == "signup") & (F.col("k") > 50)), zero), F.nullif(F.count_distinct("k") - 1, zero), F.count("*")).alias("scenes"))


@query("x11_context_block", "WITH r AS (SELECT conv_id, string_agg(turn || ' ' || role || ': ' || length(text), chr(10) ORDER BY turn, role, length(text)) AS body FROM conversations GROUP BY conv_id) SELECT conv_id, left('# Turns' || chr(10) || body, 400) AS block FROM r")
def x11(spark: SparkSession, d: str) -> DataFrame:
    """A headed list of lines, cut at the budget."""
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n"))))
    body = F.array_join(F.transform(rows, lambda x: F.concat(x["turn"].cast("string"), F.lit(" "), x["role"], F.lit(": "), x["n"].cast("string"))), "\n")
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.left(F.concat(F.lit("# Turns\n"), body), F.lit(400)).alias("block"))


@query("x12_status_machine", "SELECT doc_id, CASE WHEN n_chars = 0 THEN 'NO_FRAMES' WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN 'TRUNCATED' WHEN contains(text, '|') THEN 'PARSE_FAILED' ELSE 'OK' END AS status FROM documents")
def x12(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") == 0, "NO_FRAMES").when(~F.col("text").rlike(r"[.!?]\s*$"), "TRUNCATED").when(F.contains("text", F.lit("|")), "PARSE_FAILED").otherwise("OK").alias("status"))


@query("x13_query_text", "SELECT p_partkey, CASE WHEN lower(p_name) = lower(p_type) THEN p_name ELSE p_name || ' | ' || p_type END || ' | ' || p_brand AS q FROM part")
def x13(spark: SparkSession, d: str) -> DataFrame:
    """Text, label and hints of a requirement joined, case-insensitive repeats once."""
    parts = F.array("p_name", "p_type", "p_brand")
    keep = F.filter(parts, lambda x, i: F.array_position(F.transform(parts, lambda y: F.lower(y)), F.lower(x)) == i + 1)
    return load(spark, d, "part").select("p_partkey", F.array_join(keep, " | ").alias("q"))


@query("x14_evidence_lines", f"WITH {TIMELINE} SELECT event_id, '[' || modality || '] ' || (t0 // 60000) || ':' || lpad(CAST(t0 // 1000 % 60 AS VARCHAR), 2, '0') || ' #' || event_id AS line FROM tl")
def x14(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).select("event_id", F.concat(F.lit("["), "modality", F.lit("] "), tx.clock(F.floor(F.col("t0") / 1000)), F.lit(" #"), F.col("event_id").cast("string")).alias("line"))


@query("x20_concepts", f"WITH {LINES}, g AS (SELECT source AS name, 0 AS src, min(doc_id) AS pos FROM documents GROUP BY 1), h AS (SELECT trim(line) AS name, 1 AS src, min(doc_id) AS pos FROM ln WHERE {HEAD} GROUP BY 1), u AS (SELECT * FROM g UNION ALL SELECT * FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY src, pos) AS rn FROM u) SELECT name, src, pos FROM r WHERE rn = 1")
def x20(spark: SparkSession, d: str) -> DataFrame:
    """Group labels, then headings, a name once."""
    g = load(spark, d, "documents").groupBy(F.col("source").alias("name")).agg(F.min("doc_id").alias("pos")).withColumn("src", F.lit(0))
    h = lines(spark, d).filter(is_heading()).groupBy(F.trim("line").alias("name")).agg(F.min("doc_id").alias("pos")).withColumn("src", F.lit(1))
    return g.unionByName(h).groupBy("name").agg(F.min(F.struct("src", "pos")).alias("m")).select("name", "m.src", "m.pos")


@query("x21_angle_shaping", f"WITH {TIMELINE}, r AS (SELECT *, row_number() OVER (PARTITION BY video, modality ORDER BY t0, event_id) AS rn FROM tl WHERE rowid IS NOT NULL) SELECT video, CAST(sum(CASE WHEN modality = 'error' THEN k ELSE 0 END) AS BIGINT) AS off, sum(CASE WHEN modality = 'error' THEN k ELSE 0 END) < 200 AS matched FROM r WHERE rn <= 6 GROUP BY video".replace(" WHERE rowid IS NOT NULL", ""))
def x21(spark: SparkSession, d: str) -> DataFrame:
    """The first six records of each modality, and how much of them is off the angle."""
    r = rk.first_per(timeline(spark, d), ["video", "modality"], [F.col("t0"), F.col("event_id")], 6)
    off = F.sum(F.when(F.col("modality") == "error", F.col("k")).otherwise(0))
    return r.groupBy("video").agg(off.alias("off"), (off < 200).alias("matched"))


@query("x22_output_names", "SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'explicit' END, 'fallback') AS rationale, CAST(NULL AS VARCHAR) AS group_id FROM labels")
def x22(spark: SparkSession, d: str) -> DataFrame:
    """Renamed outputs, an explicit value first; the group id that requirements don't carry stays null."""
    return load(spark, d, "labels").select("doc_id", F.coalesce(F.when(F.col("quality") == 1, "explicit"), F.lit("fallback")).alias("rationale"), F.lit(None).cast("string").alias("group_id"))


@query("x29_recommendation_digest", f"WITH {TIMELINE}, c AS (SELECT video, event_id, k, row_number() OVER (PARTITION BY video ORDER BY k DESC, event_id) AS rn FROM tl) SELECT video, string_agg(event_id || '=' || k, ';' ORDER BY rn) AS digest FROM c WHERE rn <= 6 GROUP BY video")
def x29(spark: SparkSession, d: str) -> DataFrame:
    c = rk.first_per(timeline(spark, d), ["video"], [F.desc("k"), F.col("event_id")], 6)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("o"), "event_id", "k")))
    return c.groupBy("video").agg(F.array_join(F.transform(rows, lambda x: F.concat_ws("=", x["event_id"].cast("string"), x["k"].cast("string"))), ";").alias("digest"))


@query("s9_frame_scan", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, coalesce(event_id < lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS resorted FROM events")
def s9(spark: SparkSession, d: str) -> DataFrame:
    """Frames in order of time, those out of order marked."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, d, "events").select("event_id", (F.row_number().over(w) - 1).alias("idx"), F.coalesce(F.col("event_id") < F.lag("event_id").over(w), F.lit(False)).alias("resorted"))


@query("w6_frame_deltas", "WITH n AS (SELECT vec_id, label, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM embeddings) SELECT vec_id, round_even(list_sum(list_transform(list_zip(embedding, prev), lambda p: abs(round(p[1]::DOUBLE * 1000) - round(p[2]::DOUBLE * 1000)))) / 64, 3) AS delta FROM n WHERE prev IS NOT NULL")
def w6(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute change from one vector of a label to the next."""
    n = load(spark, d, "embeddings").withColumn("prev", F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))).filter("prev is not null")
    s = F.aggregate(F.zip_with("embedding", "prev", lambda a, b: F.abs(F.round(a.cast("double") * 1000) - F.round(b.cast("double") * 1000))), F.lit(0.0), lambda a, x: a + x)
    return n.select("vec_id", F.bround(s / 64, 3).alias("delta"))


@query("x27_figure_rows", f"WITH {TIMELINE} SELECT modality, video, min(t0) AS earliest, max(k) AS level, count(*) AS n FROM tl GROUP BY ALL")
def x27(spark: SparkSession, d: str) -> DataFrame:
    return timeline(spark, d).groupBy("modality", "video").agg(F.min("t0").alias("earliest"), F.max("k").alias("level"), F.count("*").alias("n"))


@query("geo_boxes", "WITH b AS (SELECT p_partkey, p_size AS x, p_partkey % 10 AS y FROM part), p AS (SELECT a.p_partkey AS p, greatest(0, least(a.x + 10, c.x + 10) - greatest(a.x, c.x)) * greatest(0, least(a.y + 5, c.y + 5) - greatest(a.y, c.y)) AS shared FROM b a JOIN b c ON c.p_partkey = a.p_partkey + 1) SELECT p, shared, round_even(CAST(shared AS DOUBLE) / (100 - shared), 6) AS iou, round_even(CAST(shared AS DOUBLE) / 50, 6) AS containment FROM p")
def geo(spark: SparkSession, d: str) -> DataFrame:
    """Overlap, IoU and containment of neighbouring boxes."""
    b = load(spark, d, "part").select("p_partkey", F.col("p_size").alias("x"), (F.col("p_partkey") % 10).alias("y"))
    c = b.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    both = F.greatest(F.lit(0), F.least(F.col("x") + 10, F.col("cx") + 10) - F.greatest("x", "cx")) * F.greatest(F.lit(0), F.least(F.col("y") + 5, F.col("cy") + 5) - F.greatest("y", "cy"))
    j = b.join(c, "p_partkey").withColumn("shared", both)
    return j.select(F.col("p_partkey").alias("p"), "shared", F.bround(F.col("shared").cast("double") / (100 - F.col("shared")), 6).alias("iou"), F.bround(F.col("shared").cast("double") / 50, 6).alias("containment"))


@query("r11_two_rounds")
def r11_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Asks judged in batches by a stand-in for a model: what it leaves out, judges in words that there aren't, or backs by made-up evidence is asked again, and then uncertain."""
    rows = asks(spark, d).select(F.expr("id div 50").alias("key"), "id", F.array(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("offered"))
    n = F.crc32(F.concat_ws(":", "id", "round").cast("binary")) % 10

    def model(asked: DataFrame) -> DataFrame:
        status = F.when(n == 1, "perhaps").when(F.col("id") % 3 == 0, "pass").otherwise("FAIL")
        cited = F.when(n == 2, F.array(F.lit("e0x"))).otherwise(F.col("offered"))
        return asked.filter(n != 0).select("key", "id", status.alias("status"), F.when(n > 5, "strong").otherwise("8/10").alias("alignment"), cited.alias("cited"), F.lit("seen").alias("reason"), F.lit(0).cast("long").alias("seq"))

    out = replies.ask_twice(spark, rows, model)
    return out.select("key", "id", "status", "alignment", F.array_join("cited", ",").alias("cited"), "rounds", "health", F.array_join("flags", "|").alias("flags"))
