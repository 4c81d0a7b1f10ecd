"""Queries of the text operators, each over its whole tables."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..sources import materialize
from ..sources.tables import spread, table
from . import blocks, dom, garbled, language, leaks, repeats, screen, tokens

#: Folder of the vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Split pattern that belongs to the vocabulary byte_bpe_50k; a fixed value of its definition.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _pages(spark, root, *columns):
    return table(spark, root, "pages").select(*columns)


def _facts(spark, root):
    """Small rows on each page; written once, as several steps read them."""
    return materialize(screen.page_facts(spread(_pages(spark, root, "page_id", "domain", "title", "content", "status_code"))))


def p1_found(spark, root):
    return screen.residue_pages(_facts(spark, root))


def p2_found(spark, root):
    facts = _facts(spark, root)
    return screen.spam_pages(facts).select("page_id").join(screen.residue_pages(facts), "page_id", "left_anti")


def _languages(spark, root):
    pages = _pages(spark, root, "page_id", "domain", "url", "title", "content", "language", "status_code")
    model = language.train_table(spread(pages))
    return materialize(screen.page_facts(spread(pages), extra=language.batch_labeller(model), extra_type=language.LINES))


def p3_lines(spark, root):
    facts = _languages(spark, root)
    return language.wrong_labels(facts, screen.excluded(facts))


def p3_found(spark, root):
    return p3_lines(spark, root).select("page_id", "line_no", "language")


def p3_pages(spark, root):
    return language.all_page_languages(_languages(spark, root), _pages(spark, root, "page_id", "content", "language"))


def p3_all_lines(spark, root):
    """The long lines of all pages, correctly labelled ones too."""
    return language.line_languages(_languages(spark, root))


def p3_segments(spark, root):
    """Spans of words in one language of all long lines."""
    return language.line_segments(_languages(spark, root))


def p4_restored(spark, root):
    return garbled.restore(spread(_pages(spark, root, "page_id", "title", "content")))


def p4_found(spark, root):
    return garbled.find_garbled(spread(_pages(spark, root, "page_id", "title", "content"))).select("page_id", "field")


def p5_found(spark, root):
    return blocks.repeated_lines(_pages(spark, root, "domain", "url", "content"))


def p5_blocks(spark, root):
    """How many whole repeated blocks of each length a site has."""
    found = blocks.whole_blocks(materialize(blocks.repeated_blocks(_pages(spark, root, "domain", "url", "content"))))
    return found.groupBy(F.col("site").alias("domain"), F.size("block").alias("n_lines")).agg(F.count("*").alias("n_blocks"))


def p5_cleaned(spark, root):
    return blocks.without_blocks(_pages(spark, root, "page_id", "domain", "url", "content"))


def p6_lines(spark, root):
    pages = _pages(spark, root, "page_id", "domain", "url", "title", "content", "status_code")
    both = materialize(screen.page_facts(spread(pages), extra=dom.batch_trees(), extra_type=dom.TREES))
    # The packed trees are large; the other facts are read several times.
    facts, trees = materialize(both.drop("extra")), dom.trees_of(both)
    lines = dom.marked_pages(trees, dom.fit(trees), facts.schema["page_id"].dataType.simpleString())
    return dom.furniture_lines(lines, screen.excluded(facts))


def p6_found(spark, root):
    return p6_lines(spark, root).select("page_id", "line_no")


def p6_bodies(spark, root):
    return dom.main_bodies(_pages(spark, root, "page_id", "content"), materialize(p6_lines(spark, root)))


def p8_ids(spark, root):
    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    return tokens.encode_texts(docs, "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN)


def p9_found(spark, root):
    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    return leaks.find_leaks(docs, table(spark, root, "benchmark")).select("doc_id", "item_id")


def p10_found(spark, root):
    return repeats.repetitive(spread(table(spark, root, "documents").select("doc_id", "text"))).select("doc_id")


def p10_shares(spark, root):
    docs = spread(table(spark, root, "documents").select("doc_id", "text"))
    return repeats.shares(docs).withColumn("share", F.round("share", 6))


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_lines": p3_lines,
    "p3_pages": p3_pages,
    "p3_all_lines": p3_all_lines,
    "p3_segments": p3_segments,
    "p4_found": p4_found,
    "p4_restored": p4_restored,
    "p5_found": p5_found,
    "p5_blocks": p5_blocks,
    "p5_cleaned": p5_cleaned,
    "p6_found": p6_found,
    "p6_lines": p6_lines,
    "p6_bodies": p6_bodies,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_shares": p10_shares,
}

_LINES = """lines AS (SELECT domain, url, trim(regexp_replace(unnest(string_split(content, chr(10))), '[ \t' || chr(160) || ']+', ' ', 'g')) AS line
    FROM pages WHERE domain IS NOT NULL AND domain <> '' AND content <> '')"""

ORACLES: dict[str, str] = {
    "p5_found": f"WITH {_LINES} SELECT domain, line FROM lines WHERE line <> '' GROUP BY domain, line HAVING count(DISTINCT url) >= 8",
    "p5_cleaned": f"""WITH {_LINES}, found AS (SELECT domain, line FROM lines WHERE line <> '' GROUP BY domain, line HAVING count(DISTINCT url) >= 8),
        raw AS (SELECT page_id, domain, unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM pages WHERE content IS NOT NULL),
        kept AS (SELECT r.page_id, string_agg(raw, chr(10) ORDER BY i) AS c FROM raw r LEFT JOIN found f ON f.domain = r.domain AND f.line = trim(regexp_replace(raw, '[ \t' || chr(160) || ']+', ' ', 'g')) WHERE f.line IS NULL GROUP BY r.page_id)
        SELECT page_id, CASE WHEN content IS NULL THEN NULL ELSE coalesce(c, '') END AS content FROM pages LEFT JOIN kept USING (page_id)""",
}
