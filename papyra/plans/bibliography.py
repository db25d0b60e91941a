"""Queries over records, reference lists and answers made of the texts of all documents with words enough: the tables hold none themselves.

A document gives a paper (title, names, abstract and so on are words of its text), a page that cites it in several ways, an answer, a feed entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra import tables
from papyra.functions import text as T
from papyra.functions import vocabulary as Y
from papyra.operators import citations as X
from papyra.operators import filters as P
from papyra.operators import retrieval as R
from papyra.plans.registry import query
from papyra.sources import feeds

LEAST = 40
CATS = sorted(feeds.CATEGORIES)


def _cap(i: int) -> str:
    return f"upper(substr(w[{i}], 1, 1)) || substr(w[{i}], 2)"


BASE_SQL = f"""b AS (SELECT i, w FROM (SELECT doc_id AS i, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+'), lambda x: length(x) > 1) AS w FROM documents) WHERE len(w) >= {LEAST}),
p AS (SELECT i, w, '23' || lpad(CAST(i % 12 + 1 AS VARCHAR), 2, '0') || '.' || lpad(CAST(i AS VARCHAR), 5, '0') AS id, {_cap(1)} || ' ' || array_to_string(w[2:8], ' ') AS title,
  [{_cap(9)} || ' ' || {_cap(10)}, {_cap(11)} || ' ' || {_cap(12)}] AS authors, array_to_string(w[13:{LEAST}], ' ') AS abstract, CAST(1990 + i % 30 AS INT) AS year,
  [{CATS!r}[i % 10 + 1], {CATS!r}[(i + 3) % 10 + 1]] AS categories, TIMESTAMP '2023-01-01' + to_days(CAST(i % 365 AS INT)) AS published_date FROM b)"""


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 1)
    # a filter isn't pushed below an explode, which would split the text again for each use of a word
    b = tables.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.explode(F.array(words)).alias("w")).where(F.size("w") >= LEAST)
    i = F.col("i")
    cap = lambda k: F.concat(F.upper(F.substring(F.get("w", F.lit(k - 1)), 1, 1)), F.substr(F.get("w", F.lit(k - 1)), F.lit(2)))
    cat = lambda k: F.get(F.array(*map(F.lit, CATS)), (k % 10).cast("int"))
    return b.select(
        "i", "w", F.concat(F.lit("23"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("."), F.lpad(i.cast("string"), 5, "0")).alias("id"),
        F.concat_ws(" ", cap(1), F.array_join(F.slice("w", 2, 7), " ")).alias("title"), F.array(F.concat_ws(" ", cap(9), cap(10)), F.concat_ws(" ", cap(11), cap(12))).alias("authors"),
        F.array_join(F.slice("w", 13, LEAST - 12), " ").alias("abstract"), (1990 + i % 30).cast("int").alias("year"), F.array(cat(i), cat(i + 3)).alias("categories"),
        F.timestamp_add("DAY", (i % 365).cast("int"), F.lit("2023-01-01 00:00:00").cast("timestamp")).alias("published_date"),
    )


# SRC-02
@query(f"WITH {BASE_SQL} SELECT id, title FROM p WHERE list_contains(categories, 'cs.IR') AND published_date BETWEEN TIMESTAMP '2023-01-01' AND TIMESTAMP '2023-02-28'")
def papers_in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.in_category(papers(spark, sf_dir), "cs.IR", "2023-01-01 00:00:00", "2023-02-28 00:00:00").select("id", "title")


# SRC-03, SRC-04, SRC-08
@query(f"WITH {BASE_SQL} SELECT id, title FROM p WHERE len(list_filter(authors, lambda a: contains(lower(a), 'an'))) > 0")
def papers_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.by_author(papers(spark, sf_dir), "An").select("id", "title")


# SRC-05
@query(f"WITH {BASE_SQL} SELECT id FROM p WHERE contains(lower(title), 'an') AND contains(lower(abstract), 'the') AND list_contains(categories, 'cs.IR')")
def papers_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.advanced(papers(spark, sf_dir), title="An", abstract="the", category="cs.IR").select("id")


# SRC-06: the dimension table and the papers of each category
@query(f"WITH {BASE_SQL}, c AS (SELECT unnest({CATS!r}) AS category, unnest({[feeds.CATEGORIES[c] for c in CATS]!r}) AS name), n AS (SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM p) GROUP BY 1) SELECT category, name, coalesce(n, 0) AS papers FROM c LEFT JOIN n USING (category)")
def category_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = papers(spark, sf_dir).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("papers"))
    return feeds.categories(spark).join(n, "category", "left").fillna(0, ["papers"])


# SRC-07, SF-35, SF-32
@query(f"""WITH {BASE_SQL} SELECT 'scholar_' || substr(md5(title), 1, 12) AS id, title, array_to_string(authors, ';') AS authors, year, strftime(make_date(year, 1, 1), '%Y-%m-%d') AS published, md5(lower(title) || '_' || lower(authors[1])) AS hash FROM p""")
def second_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = papers(spark, sf_dir).select("title", F.array_join("authors", " and ").alias("authors"), "year", "abstract", F.lit("V").alias("venue"), F.lit("http://u").alias("url"))
    return feeds.from_scholar(raw).select("id", "title", F.array_join("authors", ";").alias("authors"), "year", F.date_format("published_date", "yyyy-MM-dd").alias("published"), "hash")


# SRC-01, SF-34: entries as text
@query(f"""WITH {BASE_SQL} SELECT id || 'v1' AS id, title, array_to_string(authors, ';') AS authors, array_to_string(categories, ';') AS categories, CAST(2023 AS INT) AS year FROM p""")
def feed_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda x: F.lit(x)
    names = F.array_join(F.transform("authors", lambda a: F.concat(s("<author><name> "), a, s("</name></author>"))), "")
    terms = F.array_join(F.transform("categories", lambda c: F.concat(s('<category term="'), c, s('"/>'))), "")
    entry = F.concat(
        s("<entry><id>http://arxiv.org/abs/"), F.col("id"), s("v1</id><title>"), F.replace("title", s(" "), s("\n  ")), s("</title><summary>"), F.col("abstract"), s("</summary><published>"),
        F.date_format("published_date", "yyyy-MM-dd'T'HH:mm:ss'Z'"), s("</published>"), names, terms, s("</entry>"),
    )
    e = papers(spark, sf_dir).select(F.explode(F.array(F.from_xml(entry, feeds.ENTRY))).alias("e")).select("e.*")  # parsed once, as above
    return feeds.from_entries(e).select("id", "title", F.array_join("authors", ";").alias("authors"), F.array_join("categories", ";").alias("categories"), "year")


# SRC-20, SF-33: how long each event would wait at its user's n-th attempt of a day
@query("""SELECT event_id, least(pow(2, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) - 1), 60)::DOUBLE AS delay FROM events""")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt = F.expr("row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id) - 1")
    return tables.read(spark, sf_dir, "events").select("event_id", T.backoff(attempt).alias("delay"))


# SF-02, SF-03, SF-20: names in two written forms, and whether the forms share a last name
@query(f"""WITH {BASE_SQL}, n AS (SELECT i, list_filter([w[1] || ' ' || substr(w[2], 1, 1), w[3] || ' ' || substr(w[4], 1, 1) || CASE WHEN i % 2 = 0 THEN ' et al' ELSE '' END], lambda x: length(x) > 2) AS names, list_filter([w[3] || ' ' || substr(w[5], 1, 1)], lambda x: length(x) > 2) AS others FROM b)
SELECT i, array_to_string(names, ';') AS names, len(list_intersect(list_transform(names, lambda x: string_split(x, ' ')[1]), list_transform(others, lambda x: string_split(x, ' ')[1]))) > 0 AS shared FROM n""")
def author_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = lambda k: F.get("w", F.lit(k - 1))
    name = lambda a, b: F.concat(F.initcap(w(a)), F.lit(", "), F.upper(F.substring(w(b), 1, 1)), F.lit("."))
    both = F.concat(name(1, 2), F.when(F.col("i") % 3 == 0, "; ").otherwise(" and "), name(3, 4), F.when(F.col("i") % 2 == 0, " et al.").otherwise(""))
    one, two = T.author_names(both), T.author_names(name(3, 5))
    return papers(spark, sf_dir).select("i", F.array_join(one, ";").alias("names"), F.arrays_overlap(T.last_names(one), T.last_names(two)).alias("shared"))


# IR-36
@query(f"WITH {BASE_SQL} SELECT i, CAST(k - 1 AS INT) AS position, [array_to_string(w[1:4], ' '), array_to_string(w[5:7], ' '), w[8]][k] AS entry FROM b, range(1, 4) t(k)")
def numbered_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    text = F.concat(F.lit("[1] "), part(1, 4), F.lit("\n[2] "), part(5, 3), F.lit(" [3] "), part(8, 1))
    return papers(spark, sf_dir).select("i", F.posexplode(X.numbered_entries(text)).alias("position", "entry"))


#: Of each document a page: a line that cites in four ways and three references.
PAGE_SQL = f"""{BASE_SQL}, r AS (SELECT i, year, {_cap(9)} AS name, array_to_string(w[1:5], ' ') AS t1, array_to_string(w[6:10], ' ') AS t2, array_to_string(w[11:15], ' ') AS t3, lpad(CAST(i AS VARCHAR), 5, '0') AS five FROM p),
x AS (SELECT *, name || ', J. "' || t1 || '". In Proceedings of Data ' || year || '. doi:10.1000/' || i AS r1, name || ', B. "' || t2 || '". arXiv:2301.' || five AS r2, name || ', G. "' || t3 || '". Journal 2019. https://doi.org/10.5678/x' || i AS r3 FROM r),
page AS (SELECT *, 'Here cites [1] and [2, 3] and (' || name || ' et al., ' || year || '). According to ' || name || ' et al. (2019) it holds.' || chr(10) || 'References' || chr(10) || '[1] ' || r1 || chr(10) || '[2] ' || r2 || chr(10) || '[3] ' || r3 || chr(10) AS text FROM x)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, five = F.lit, F.lpad(F.col("i").cast("string"), 5, "0")
    name = F.concat(F.upper(F.substring(F.get("w", s(8)), 1, 1)), F.substr(F.get("w", s(8)), s(2)))
    title = lambda a: F.array_join(F.slice("w", a, 5), " ")
    r1 = F.concat(name, s(', J. "'), title(1), s('". In Proceedings of Data '), "year", s(". doi:10.1000/"), "i")
    r2, r3 = F.concat(name, s(', B. "'), title(6), s('". arXiv:2301.'), five), F.concat(name, s(', G. "'), title(11), s('". Journal 2019. https://doi.org/10.5678/x'), "i")
    text = F.concat(s("Here cites [1] and [2, 3] and ("), name, s(" et al., "), "year", s("). According to "), name, s(" et al. (2019) it holds.\nReferences\n[1] "), r1, s("\n[2] "), r2, s("\n[3] "), r3, s("\n"))
    return papers(spark, sf_dir).select("i", text.alias("text"))


VENUE_SQL = "coalesce(" + ", ".join(f"nullif(regexp_extract(raw, '{p}', 1), '')" for p in Y.VENUES) + ")"


# IR-25..28, SF-06, SF-07, FLT-16
@query(f"""WITH {PAGE_SQL}, e AS (SELECT i, 0 AS position, r1 AS raw, '10.1000/' || i AS doi, NULL AS arxiv_id, year, t1 AS title, name || ', J.' AS authors FROM page
UNION ALL SELECT i, 1, r2, NULL, '2301.' || five, NULL, t2, name || ', B.' FROM page UNION ALL SELECT i, 2, r3, '10.5678/x' || i, NULL, 2019, t3, name || ', G.' FROM page),
v AS (SELECT *, {VENUE_SQL} AS venue, CASE WHEN length(authors) BETWEEN 4 AND 99 THEN authors END AS people FROM e)
SELECT i, CAST(position AS INT) AS position, doi, arxiv_id, CAST(year AS INT) AS year, title, people AS authors, venue, length(raw) >= 20 AS valid,
round(least(0.2 + CASE WHEN doi IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN arxiv_id IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN venue IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN people IS NOT NULL THEN 0.1 ELSE 0 END, 1.0), 6) AS confidence FROM v""")
def regex_citation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.parse(X.explode_entries(pages(spark, sf_dir), "i"))
    valid = P.valid_citation(F.col("doi"), F.col("arxiv_id"), F.col("title"), F.col("raw_text"), F.col("confidence"))
    return found.select("i", "position", "doi", "arxiv_id", "year", "title", "authors", "venue", valid.alias("valid"), "confidence")


# IR-30
@query(f"WITH {PAGE_SQL} SELECT i, '10.1000/' || i || ' 10.5678/x' || i AS dois, '2301.' || five AS arxiv_ids FROM page")
def doi_arxiv_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    dois, arxiv = X.identifiers(F.col("text"))
    return pages(spark, sf_dir).select("i", F.array_join(dois, " ").alias("dois"), F.array_join(arxiv, " ").alias("arxiv_ids"))


IN_TEXT_SQL = " UNION ALL ".join(f"SELECT i, '{k}' AS kind, unnest(regexp_extract_all(text, '{p}')) AS cited, 0.8 AS confidence FROM page" for k, p in X.IN_TEXT.items())


# IR-29, ST-08, WN-20
@query(f"""WITH {PAGE_SQL}, f AS ({IN_TEXT_SQL} UNION ALL SELECT i, 'context', unnest(['According to ' || name || ' et al']), 0.6 FROM page
UNION ALL SELECT i, 'reference', unnest(list_filter(['[1] ' || r1, '[2] ' || r2, '[3] ' || r3], lambda x: length(x) > 20)), 0.9 FROM page) SELECT i, kind, cited, CAST(max(confidence) AS DOUBLE) AS confidence FROM f GROUP BY i, kind, cited""")
def intext_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.in_text(pages(spark, sf_dir), "i")


ANSWER_SQL = f"{BASE_SQL}, a AS (SELECT i, id, title, ['arxiv:' || id, 'doi:10.1/' || i] AS available, CASE i % 3 WHEN 0 THEN 'As [arxiv:' || id || '] shows, and [missing:x' || i || '], [arxiv:' || id || '].' WHEN 1 THEN 'Nothing cited by ' || w[1] ELSE '[doi:10.1/' || i || '] (ARXIV:' || id || ') arxiv:' || id END AS answer FROM p)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, i = F.lit, F.col("i")
    arxiv, doi = F.concat(s("arxiv:"), "id"), F.concat(s("doi:10.1/"), i.cast("string"))
    answer = F.when(i % 3 == 0, F.concat(s("As ["), arxiv, s("] shows, and [missing:x"), i, s("], ["), arxiv, s("]."))).when(i % 3 == 1, F.concat(s("Nothing cited by "), F.get("w", s(0)))).otherwise(F.concat(s("["), doi, s("] (ARXIV:"), "id", s(") "), arxiv))
    return papers(spark, sf_dir).select("i", "title", F.array(arxiv, doi).alias("available"), answer.alias("answer"))


# IR-35, SF-24, SF-25, ST-07
@query(f"""WITH {ANSWER_SQL}, u AS (SELECT i, available, list_sort(list_distinct(regexp_extract_all(answer, '\\[([A-Za-z]+:[^\\]]+)\\]', 1))) AS used FROM a)
SELECT i, array_to_string(list_filter(used, lambda x: list_contains(available, x)), ' ') AS valid, array_to_string(list_filter(used, lambda x: NOT list_contains(available, x)), ' ') AS missing,
CASE WHEN len(used) = 0 THEN 1.0 ELSE len(list_filter(used, lambda x: list_contains(available, x))) / len(used) END AS coverage FROM u""")
def citation_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.validate_citations(answers(spark, sf_dir))
    return v.select("i", F.array_join("valid", " ").alias("valid"), F.array_join("missing", " ").alias("missing"), "coverage")


# SF-26: letter case aside
@query(f"""WITH {ANSWER_SQL}, l AS (SELECT i, replace(replace(replace(answer, '[arxiv:' || id || ']', '<' || title || '>'), '(ARXIV:' || id || ')', '<' || title || '>'), 'arxiv:' || id, '<' || title || '>') AS t FROM a) SELECT i, replace(t, '[doi:10.1/' || i || ']', '<doi>') AS linked FROM l""")
def linked_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.array(F.concat(F.lit("<"), "title", F.lit(">")), F.lit("<doi>"))
    return answers(spark, sf_dir).select("i", T.link_citations(F.col("answer"), F.col("available"), shown).alias("linked"))


# IR-34, SF-24
@query(f"""WITH {BASE_SQL}, c AS (SELECT i, title, authors[1] || '; ' || authors[2] AS authors, CASE WHEN i % 5 > 0 THEN year END AS year, CASE i % 3 WHEN 0 THEN 'arxiv:' || id WHEN 1 THEN 'doi:10.1/' || i ELSE 'paper_' || i END AS cid FROM p)
SELECT cid, CASE WHEN starts_with(cid, 'arxiv:') THEN 'arxiv' WHEN starts_with(cid, 'doi:') THEN 'doi' ELSE 'unknown' END AS kind,
CASE WHEN starts_with(cid, 'arxiv:') THEN 'https://arxiv.org/abs/' || substr(cid, 7) WHEN starts_with(cid, 'doi:') THEN 'https://doi.org/' || substr(cid, 5) END AS url,
'(' || string_split_regex(authors, '[;,]')[1] || ', ' || coalesce(CAST(year AS VARCHAR), 'n.d.') || ')' AS academic, '[' || cid || ']' AS brief, authors || '. (' || coalesce(CAST(year AS VARCHAR), 'n.d.') || '). ' || title || coalesce('. ' || CASE WHEN starts_with(cid, 'arxiv:') THEN 'https://arxiv.org/abs/' || substr(cid, 7) WHEN starts_with(cid, 'doi:') THEN 'https://doi.org/' || substr(cid, 5) END, '') AS whole FROM c""")
def citation_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    cid = T.cite_id(F.when(i % 3 == 0, F.col("id")), F.when(i % 3 == 1, F.concat(F.lit("10.1/"), i.cast("string"))), i)
    c = papers(spark, sf_dir).select("title", F.array_join("authors", "; ").alias("authors"), F.when(i % 5 > 0, F.col("year")).alias("year"), cid.alias("cid"))
    f = lambda s: R.format_citation(F.col("title"), F.col("authors"), F.col("year"), F.col("cid"), s)
    return c.select("cid", T.cite_type(F.col("cid")).alias("kind"), T.cite_url(F.col("cid")).alias("url"), f("academic").alias("academic"), f("brief").alias("brief"), f("full").alias("whole"))


# SF-01, SF-08
@query(f"""WITH {BASE_SQL}, n AS (SELECT i, CASE i % 3 WHEN 0 THEN 'The ' || title WHEN 1 THEN title || ' (Extended: Version)' ELSE 'A ' || w[1] || '-' || w[2] || ': ' || w[3] || ' & ' || w[4] END AS t FROM p)
SELECT i, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(t)), '^(the|a|an) ', ''), ' *\\([^)]*\\) *$', ''), '[^\\p{{L}}\\p{{N}}_ \\t\\n\\r]', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS plain,
substr(regexp_replace(regexp_replace(t, '[^\\p{{L}}\\p{{N}}_ \\-]', '', 'g'), '[ \\-]+', '_', 'g'), 1, 50) AS slug FROM n""")
def title_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s, w = F.col("i"), F.lit, lambda k: F.get("w", F.lit(k - 1))
    t = F.when(i % 3 == 0, F.concat(s("The "), "title")).when(i % 3 == 1, F.concat("title", s(" (Extended: Version)"))).otherwise(F.concat(s("A "), w(1), s("-"), w(2), s(": "), w(3), s(" & "), w(4)))
    return papers(spark, sf_dir).select("i", t.alias("t")).select("i", T.normalize_title(F.col("t")).alias("plain"), T.slug(F.col("t")).alias("slug"))


# SF-11, SF-31
@query(f"""WITH {BASE_SQL}, m AS (SELECT i, title, CASE i % 4 WHEN 0 THEN '"' || title || '"' WHEN 1 THEN title WHEN 2 THEN ' ' || w[1] || chr(10) || w[2] || ' ' ELSE '''''' END AS said FROM p), c AS (SELECT *, replace(regexp_replace(trim(said, ' ' || chr(9) || chr(10) || chr(13)), '^["'']|["'']$', '', 'g'), chr(10), ' ') AS c FROM m)
SELECT i, CASE WHEN c <> '' AND c <> title THEN c END AS answer, length(said) // 4 AS tokens FROM c""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, s = F.col("i"), F.lit
    said = F.when(i % 4 == 0, F.concat(s('"'), "title", s('"'))).when(i % 4 == 1, F.col("title")).when(i % 4 == 2, F.concat(s(" "), F.get("w", s(0)), s("\n"), F.get("w", s(1)), s(" "))).otherwise("''")
    return papers(spark, sf_dir).select("i", "title", said.alias("said")).select("i", T.clean_answer(F.col("said"), F.col("title")).alias("answer"), T.estimate_tokens(F.col("said")).alias("tokens"))
