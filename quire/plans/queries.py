"""The registered queries of the document engine, over the driver's tables.

Texts come from ``documents`` as laid out by ``synthetic``; titles and files from ``pages``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import artifacts as A
from quire.operators import baseline, chunking, layout, linking, quality, sections, views
from quire.operators import blocks as B
from quire.operators import columns as O
from quire.plans import pipeline, synthetic
from quire.sources import files, store
from quire.sources.shared import written

BOX = ("x0", "y0", "x1", "y1")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


# ---- baseline -------------------------------------------------------------------------


def baseline_windows(spark, sf_dir):
    w = baseline.windows(_documents(spark, sf_dir), "doc_id", "text")
    bare = X.strip(F.col("raw"))
    return w.select(
        "doc_id",
        "order_index",
        F.length("raw").alias("chars"),
        F.sha1(bare).alias("text_sha1"),
        X.word_count(F.col("raw")).alias("token_count"),
        X.starts_mid_word(F.col("raw")).alias("mid_word"),
    )


def baseline_pages(spark, sf_dir):
    chunks = baseline.baseline_chunks(synthetic.flat(_documents(spark, sf_dir)))
    return chunks.select("chunk_id", "paper_id", "order_index", "page_start", "page_end", "token_count")


def midword_share(spark, sf_dir):
    w = baseline.windows(_documents(spark, sf_dir, "source", "text"), "source", "text")
    return quality.scoreboard(w.select("source", F.col("raw").alias("text"), F.lit("unknown").alias("section")), "source")


def window_sweep(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    sizes = (400, 800, 1200, 2000, 4000)
    one = lambda n: F.transform(baseline.window_texts(F.col("text"), n), lambda w: F.struct(F.lit(n).alias("size"), X.starts_mid_word(w).alias("mid")))
    every = docs.select(F.explode(F.concat(*[one(n) for n in sizes])).alias("w"))
    return every.groupBy(F.col("w.size").alias("size")).agg(F.count("*").alias("chunks"), F.count_if("w.mid").alias("mid_word"))


def paper_ids(spark, sf_dir):
    p = _pages(spark, sf_dir)
    name = F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".pdf"))
    return p.select(
        "page_id",
        files.paper_id(name, F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("paper_id"),
        files.is_pdf(name).alias("accepted"),
    )


def _html_title() -> Column:
    return F.regexp_extract(F.coalesce("html", F.lit("")), "(?s)<title>(.*?)</title>", 1)


def clean_titles(spark, sf_dir):
    name = F.concat(F.col("page_id").cast("string"), F.lit(".pdf"))
    raw = F.when(F.col("page_id") % 10 == 0, F.lit(" Untitled ")).when(F.col("page_id") % 10 == 1, name).otherwise(_html_title())
    return _pages(spark, sf_dir).select("page_id", X.clean_title(raw, name).alias("title"))


def safe_names(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", X.safe_name(F.col("page_id").cast("string"), _html_title()).alias("name"))


def file_sizes(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", X.human_size(F.octet_length("html").cast("bigint")).alias("size"))


# ---- layout ---------------------------------------------------------------------------


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts and figures as blocks, with kinds from captions."""
    text = synthetic.text_rows(docs)
    figure = synthetic.figure_rows(docs)
    kinds = layout.caption_kinds(text, figure)
    figure = figure.join(kinds, ["paper_id", "page", "pos"], "left")
    null = lambda t: F.lit(None).cast(t)
    cols = ["paper_id", "page", "pos", *BOX, "text", "font_size", "bold_ratio"]
    a = text.select(*cols).withColumns({"image": F.lit(False), "kind": null("string"), "math_ratio": F.lit(0.0)})
    b = figure.withColumns(
        {"text": F.lit(""), "font_size": null("double"), "bold_ratio": F.lit(0.0), "image": F.lit(True), "math_ratio": F.lit(0.0)}
    ).select(*a.columns)
    sizes = F.when(~F.col("image"), F.array(F.struct(F.col("font_size").alias("size"), F.length(X.strip(F.col("text"))).alias("chars"))))
    return a.unionByName(b).withColumn("sizes", sizes)


def _regions(spark, sf_dir) -> DataFrame:
    """Labelled regions of the synthetic pages, written: most queries read them twice."""
    docs = _documents(spark, sf_dir)
    return written(sections.assign_sections(layout.to_regions(_blocks(docs), synthetic.pages(docs))), "regions")


def _flat_box(r: DataFrame) -> DataFrame:
    return r.select(*[c for c in r.columns if c != "bbox"], F.col("bbox.page").alias("page"), *[F.col(f"bbox.{c}").alias(c) for c in BOX])


def heading_class(spark, sf_dir):
    rows = synthetic.text_rows(_documents(spark, sf_dir)).filter("role = 'heading'")
    name = F.regexp_replace("text", r"^\d+\. ", "")
    made = {
        "plain": F.col("text"),
        "filler": F.concat(F.lit("2.1 Our "), name),
        "combined": F.concat(F.lit("IV. "), name, F.lit(" and Motivation")),
        "buried": F.concat(F.lit("On "), name),
    }
    return rows.select(
        "paper_id", "i", *[X.classify_section(c).alias(n) for n, c in made.items()], X.strip_numbering(F.col("text")).alias("bare")
    )


def coverage_gutters(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return O.gutters(synthetic.text_rows(docs), synthetic.pages(docs))


def reading_order(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    blocks, pages = synthetic.text_rows(docs), synthetic.pages(docs)
    ordered = O.reading_order(blocks, O.edges(O.gutters(blocks, pages), pages))
    return ordered.select("paper_id", "page", "i", "column_index", "order_index")


def table_rules(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    rules = layout.table_rules(synthetic.drawings(docs), synthetic.pages(docs), synthetic.figure_rows(docs))
    return layout.ruled_tables(rules, synthetic.text_rows(docs))


def image_merge(spark, sf_dir):
    return B.merge_image_fragments(synthetic.images(_documents(spark, sf_dir)))


def body_size(spark, sf_dir):
    rows = synthetic.text_rows(_documents(spark, sf_dir))
    sized = rows.withColumn("sizes", F.array(F.struct(F.col("font_size").alias("size"), F.length(X.strip(F.col("text"))).alias("chars"))))
    return B.body_sizes(sized)


def font_profile(spark, sf_dir):
    top, _ = B.font_profile(synthetic.spans(_documents(spark, sf_dir)))
    return top


def font_totals(spark, sf_dir):
    _, by_page = B.font_profile(synthetic.spans(_documents(spark, sf_dir)))
    return by_page


def block_measures(spark, sf_dir):
    b = B.text_blocks(synthetic.spans(_documents(spark, sf_dir)))
    r = lambda c: F.round(c, 9).alias(c)
    return b.select("paper_id", "page", "block_no", F.sha1("text").alias("text_sha1"), "font_size", r("bold_ratio"), r("math_ratio"))


def page_furniture(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    rows = synthetic.text_rows(docs)
    # the last line of each column at the page's foot, as a page number on every third page
    foot = (F.col("pos") % 12 == 10) & (F.col("page") % 3 == 0)
    number = F.concat(F.lit("- "), (F.col("page") + 1).cast("string"), F.lit(" -"))
    moved = rows.withColumns(
        {"text": F.when(foot, number).otherwise(F.col("text")), "y0": F.when(foot, 740.0).otherwise(F.col("y0")), "y1": F.when(foot, 752.0).otherwise(F.col("y1"))}
    )
    return B.drop_furniture(moved, synthetic.pages(docs)).select("paper_id", "page", "pos")


def classify_blocks(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    r = layout.to_regions(_blocks(docs), synthetic.pages(docs))
    return r.select("paper_id", "order_index", "region_type", "column_index", F.sha1("text").alias("text_sha1"))


def absorb_text(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    # boxes over the third row of the left column, from its second line to its fourth
    boxes = synthetic.figure_rows(docs).withColumns({"y0": F.lit(215.0), "y1": F.lit(390.0)})
    _, figures = layout.absorb(synthetic.text_rows(docs), boxes)
    return figures.select("paper_id", "page", "pos", F.sha1("absorbed").alias("absorbed_sha1"), F.length("absorbed").alias("chars"))


def absorb_rest(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    boxes = synthetic.figure_rows(docs).withColumns({"y0": F.lit(215.0), "y1": F.lit(390.0)})
    rest, _ = layout.absorb(synthetic.text_rows(docs), boxes)
    return rest.select("paper_id", "page", "pos")


def caption_kinds(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return layout.caption_kinds(synthetic.text_rows(docs), synthetic.figure_rows(docs))


def figure_merge(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return layout.figure_boxes(synthetic.bars(docs), synthetic.text_rows(docs))


def equation_merge(spark, sf_dir):
    made = layout.equation_boxes(synthetic.formulas(_documents(spark, sf_dir)))
    return made.select("paper_id", "page", *BOX, F.sha1("text").alias("text_sha1"))


def layout_regions(spark, sf_dir):
    """The whole layout of decoded pages: figures, tables, formulas, columns, order, kinds."""
    s = synthetic.Synthetic(_documents(spark, sf_dir))
    r = sections.assign_sections(layout.extract_regions(s.spans, s.images, s.drawings, s.pages))
    return _flat_box(r)


# ---- sections, chunks, artifacts, links -------------------------------------------------


def section_carry(spark, sf_dir):
    return _regions(spark, sf_dir).select("paper_id", "order_index", "section", "section_title_raw")


def paper_titles(spark, sf_dir):
    return sections.paper_titles(_regions(spark, sf_dir))


def chunks(spark, sf_dir):
    c = chunking.chunk_regions(_regions(spark, sf_dir))
    return c.select(
        "chunk_id", "section", "section_title_raw", F.sha1("text").alias("text_sha1"), "page_start", "page_end",
        *[F.col(f"bbox.{x}").alias(x) for x in BOX], "order_index", "token_count",
    )


def caption_pairs(spark, sf_dir):
    return A.pair_captions(_regions(spark, sf_dir)).select("artifact_region", F.sha1("caption").alias("caption_sha1"))


def artifacts(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    a = A.extract_artifacts(_regions(spark, sf_dir), A.page_images(synthetic.pages(docs)))
    return _flat_box(a).select("artifact_id", "artifact_type", F.sha1("caption").alias("caption_sha1"), "page", *BOX, "image_path")


def crop_boxes(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    r = _regions(spark, sf_dir)
    c = A.crop_boxes(A.targets(r), r, A.page_images(synthetic.pages(docs)))
    return c.select("region_id", *[F.round(x, 6).alias(x) for x in BOX], "px0", "py0", "px1", "py1")


def page_images(spark, sf_dir):
    return A.page_images(synthetic.pages(_documents(spark, sf_dir)))


def refs(spark, sf_dir):
    rows = synthetic.text_rows(_documents(spark, sf_dir)).withColumnRenamed("i", "chunk_id")
    return linking.chunk_references(rows).select("paper_id", F.col("chunk_id").alias("i"), "kind", "num")


def _linked(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    _, c, a = pipeline.structured(layout.to_regions(*_block_pages(spark, sf_dir)), None)
    return a, c


def _block_pages(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = _documents(spark, sf_dir)
    return _blocks(docs), synthetic.pages(docs)


def links(spark, sf_dir):
    r = _regions(spark, sf_dir)
    return linking.links(A.extract_artifacts(r), chunking.chunk_regions(r))


# ---- checks ---------------------------------------------------------------------------


def page_checks(spark, sf_dir):
    p = quality.page_problems(_regions(spark, sf_dir))
    return p.select("paper_id", "page", F.array_join("problems", "; ").alias("problems"))


def paper_report(spark, sf_dir):
    return quality.paper_report(_regions(spark, sf_dir)).drop("problems", "readable")


def corpus_totals(spark, sf_dir):
    return quality.corpus_totals(quality.paper_report(_regions(spark, sf_dir)))


def run_scoreboard(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    flat = baseline.baseline_chunks(synthetic.flat(docs)).select(F.lit("baseline").alias("run"), "section", "text")
    cut = chunking.chunk_regions(_regions(spark, sf_dir)).select(F.lit("layout").alias("run"), "section", "text")
    return quality.scoreboard(flat.unionByName(cut), "run")


# ---- views ----------------------------------------------------------------------------


def region_tally(spark, sf_dir):
    return views.region_tally(_regions(spark, sf_dir))


def busiest_pages(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    v = views.busiest_page(_regions(spark, sf_dir), A.page_images(synthetic.pages(docs)))
    return v.select("paper_id", "busiest", F.concat_ws(",", F.transform("pages", lambda p: p.cast("string"))).alias("pages"))


def section_run(spark, sf_dir):
    return views.section_run(_regions(spark, sf_dir))


def chunk_stats(spark, sf_dir):
    return views.chunk_stats(chunking.chunk_regions(_regions(spark, sf_dir)))


def chunk_preview(spark, sf_dir):
    return views.chunk_preview(chunking.chunk_regions(_regions(spark, sf_dir)))


def artifact_summary(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return views.artifact_summary(A.extract_artifacts(_regions(spark, sf_dir), A.page_images(synthetic.pages(docs))))


def artifact_tiles(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    t = views.artifact_tiles(A.extract_artifacts(_regions(spark, sf_dir), A.page_images(synthetic.pages(docs))))
    return t.withColumn("caption", F.sha1("caption"))


def link_previews(spark, sf_dir):
    p = views.link_previews(*_linked(spark, sf_dir))
    return p.select("paper_id", "place", "artifact_type", "page", "chunk", "section", F.sha1("caption").alias("caption_sha1"), F.sha1(F.concat("before", F.lit("|"), "marked", F.lit("|"), "after")).alias("passage_sha1"))


def overlay_legend(spark, sf_dir):
    return views.overlay_legend(_regions(spark, sf_dir))


def link_stats(spark, sf_dir):
    return views.link_stats(*_linked(spark, sf_dir))


def kwic(spark, sf_dir):
    return views.keyword_in_context(*_linked(spark, sf_dir))


def headline(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    r = _regions(spark, sf_dir)
    c = chunking.chunk_regions(r)
    return views.headline(r, c, A.extract_artifacts(r), baseline.baseline_chunks(synthetic.flat(docs)))


def exemplars(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    e = views.exemplars(baseline.baseline_chunks(synthetic.flat(docs)), chunking.chunk_regions(_regions(spark, sf_dir)))
    return e.select("paper_id", F.sha1("broken").alias("broken_sha1"), F.sha1("whole").alias("whole_sha1"))


def comparison(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return views.comparison(baseline.baseline_chunks(synthetic.flat(docs)), chunking.chunk_regions(_regions(spark, sf_dir)))


def overlay(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return views.overlay(_regions(spark, sf_dir), A.page_images(synthetic.pages(docs)))


def gallery(spark, sf_dir):
    return views.gallery(A.page_images(synthetic.pages(_documents(spark, sf_dir))))


def page_strip(spark, sf_dir):
    v = views.page_strip(A.page_images(synthetic.pages(_documents(spark, sf_dir))))
    return v.select("paper_id", "pages", F.concat_ws(",", "shown").alias("shown"))


def paper_cards(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    r = _regions(spark, sf_dir)
    titles = sections.paper_titles(r)
    return views.paper_cards(titles, synthetic.pages(docs), chunking.chunk_regions(r), A.extract_artifacts(r)).drop("damaged")


def result_records(spark, sf_dir):
    """One nested record per paper from the whole pipeline, as JSON."""
    s = synthetic.Synthetic(_documents(spark, sf_dir))
    made = pipeline.run_pipeline(s)
    papers = made.papers.withColumn("ingested_at", F.lit(None).cast("timestamp"))
    found = store.results(papers, made.pages, made.regions, made.chunks, made.artifacts)
    return store.to_records(found)


QUERIES = {
    f.__name__: f
    for f in (
        baseline_windows, baseline_pages, midword_share, window_sweep, paper_ids, clean_titles, safe_names, file_sizes,
        heading_class, coverage_gutters, reading_order, table_rules, image_merge, body_size, font_profile, font_totals,
        block_measures, page_furniture, classify_blocks, absorb_text, absorb_rest, caption_kinds, figure_merge, equation_merge, layout_regions,
        section_carry, paper_titles, chunks, caption_pairs, artifacts, crop_boxes, page_images, refs, links,
        page_checks, paper_report, corpus_totals, run_scoreboard,
        region_tally, busiest_pages, section_run, chunk_stats, chunk_preview, artifact_summary, artifact_tiles, link_stats, link_previews, kwic,
        headline, exemplars, comparison, overlay, overlay_legend, gallery, page_strip, paper_cards, result_records,
    )
}
