"""The queries of the engine's own operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.functions import detectors, hygiene, markdown, tables
from sievelake.functions.images import detect_regions
from sievelake.functions.metadata import PNG_SIGN, XMP_UUID
from sievelake.operators import files, text
from sievelake.operators.temporal import asof_join, interval_join
from sievelake.options import MarkdownOptions, TextOptions
from sievelake.plans.planted import planted, planted_documents
from sievelake.session import new_folder
from sievelake.sources.sink import LISTING, write_files
from sievelake.sources.files import as_json, classify, is_supported, output_path, read_files
from sievelake.streaming.budgets import budgets
from sievelake.streaming.signals import bursts, read_stream, signal_rates


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With planted signals."""
    return planted_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def hygiene_strip(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", hygiene.strip_invisible(t).alias("cleaned"), hygiene.count_invisible(t).alias("stripped"))


def hygiene_substitute(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", hygiene.substitute_punctuation(t).alias("cleaned"), hygiene.count_substituted(t).alias("substituted"))


def hygiene_confidence(spark, sf_dir):
    t = F.col("text")
    n = hygiene.count_invisible(t) + hygiene.count_substituted(t)
    return documents(spark, sf_dir).select("doc_id", n.alias("items"), hygiene.confidence(n).alias("confidence"), F.md5(hygiene.tidy(t).cast("binary")).alias("cleaned_md5"))


def hygiene_nfkc(spark, sf_dir):
    return text.normalise(documents(spark, sf_dir)).select("doc_id", F.md5(F.col("normalised").cast("binary")).alias("normalised_md5"))


def hygiene_log(spark, sf_dir):
    """Removals of single characters, with positions; normalisation has a row too, left out here."""
    return text.removal_log(documents(spark, sf_dir)).filter("type <> 'nfkc-normalization'").select("doc_id", "item", "type", "position", "length")


def codepoint_inventory(spark, sf_dir):
    return text.codepoint_inventory(documents(spark, sf_dir), ["lang"])


def collapse_whitespace(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.md5(hygiene.collapse_whitespace(F.col("text")).cast("binary")).alias("cleaned_md5"))


def word_tokens(spark, sf_dir):
    words = documents(spark, sf_dir).select("lang", hygiene.tokenize_words(F.col("text")).alias("w"))
    return words.groupBy("lang").agg(F.sum(F.size("w")).alias("words"), F.max(F.size("w")).alias("most"))


def signal_counts(spark, sf_dir):
    return text.signal_counts(documents(spark, sf_dir), ["lang", "source"])


def detect_text(spark, sf_dir):
    return text.detect_text(documents(spark, sf_dir)).select("doc_id", "vendor", "pattern", "confidence", "position", "length")


def clean_text(spark, sf_dir):
    out = text.clean_text(documents(spark, sf_dir), options=TextOptions(collapse_whitespace=True))
    return out.select("doc_id", F.md5(F.col("clean_text").cast("binary")).alias("cleaned_md5"), F.size("clean_removed").alias("removed"), F.size("clean_detections").alias("detections"), F.col("clean_confidence").alias("confidence"))


def remove_controls(spark, sf_dir):
    """The removers that SQL can follow: OpenAI's, Gemini's, and clusters of dashes."""
    r = detectors.removers("OpenAI", "Gemini")(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.md5(r["OpenAI"].cast("binary")).alias("controls_md5"), F.md5(r["Gemini"].cast("binary")).alias("selectors_md5"))


def remove_markup(spark, sf_dir):
    vendors = ("Claude", "DeepSeek", "Grok", "Mistral")
    r = detectors.removers(*vendors)(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", *[F.md5(r[v].cast("binary")).alias(f"{v.lower()}_md5") for v in vendors])


def markdown_lines(spark, sf_dir):
    lines = documents(spark, sf_dir).select("doc_id", "lang", F.posexplode(F.split(markdown.newlines(F.col("text")), "\n", -1)).alias("line_no", "line"))
    # each line is written eleven times over: next to like lines it takes less, and a sort in partitions shuffles nothing
    lines = lines.sortWithinPartitions("lang", "line")
    return lines.select("doc_id", "line_no", *[c.alias(k) for k, c in markdown.line_rules(F.col("line")).items()])


def markdown_blocks(spark, sf_dir):
    t = F.col("text")
    return documents(spark, sf_dir).select("doc_id", F.md5(markdown.without_frontmatter(t).cast("binary")).alias("frontmatter_md5"), F.md5(markdown.without_comments(t).cast("binary")).alias("comments_md5"), F.md5(markdown.without_signature(t).cast("binary")).alias("signature_md5"), F.md5(markdown.without_boilerplate(t).cast("binary")).alias("boilerplate_md5"))


def markdown_clean(spark, sf_dir):
    out = documents(spark, sf_dir).select("doc_id", markdown.clean_markdown(F.col("text")).alias("m"))
    return out.select("doc_id", F.md5(F.col("m.cleaned").cast("binary")).alias("cleaned_md5"), F.size("m.removed").alias("removed"), F.size("m.artifacts").alias("artifacts"), "m.code_blocks_found", "m.code_blocks_preserved", "m.frontmatter_removed")


def markdown_strip_all(spark, sf_dir):
    out = documents(spark, sf_dir).select("doc_id", markdown.clean_markdown(F.col("text"), MarkdownOptions.strip_all()).alias("m"))
    return out.select("doc_id", F.md5(F.col("m.cleaned").cast("binary")).alias("cleaned_md5"), "m.code_blocks_found", "m.code_blocks_preserved")


def markdown_detect(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", F.explode(markdown.detect_markdown(F.col("text"))).alias("a"))
    return found.select("doc_id", "a.type", "a.line")


def markdown_segments(spark, sf_dir):
    found = documents(spark, sf_dir).select("doc_id", F.explode(markdown.markdown_segments(F.col("text"))).alias("s"))
    return found.select("doc_id", "s.seg", "s.kind", "s.fence", F.size("s.lines").alias("lines"))


def html_metadata(spark, sf_dir):
    meta = F.when(F.col("page_id") % 3 == 0, '<meta name="Generator" content="site builder"><meta property="article:author" content="A. Writer">').otherwise("")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), meta)).cast("binary").alias("content"), F.lit(".html").alias("extension"))
    return files.inspect_files(pages).groupBy("container", "key", "value").agg(F.count("*").alias("files"))


def parts(spark, sf_dir) -> DataFrame:
    """Dealt to tasks: the table is a few bytes for each part, so that a scan's task would make and clean the files of very many."""
    return spark.read.parquet(f"{sf_dir}/part.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")


def png_chunk(kind: str, body):
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0")), F.lit(kind.encode()), body, F.lit(b"\0\0\0\0"))


def png_content():
    """A header, a text chunk with its name for every second, a manifest for every fifth, an end."""
    none = F.lit(b"")
    body = F.concat(F.lit(b"Author\0"), F.col("p_name").cast("binary"))
    return F.concat(F.lit(PNG_SIGN), png_chunk("IHDR", F.lit(bytes(13))), F.when(F.col("p_partkey") % 2 == 0, png_chunk("tEXt", body)).otherwise(none), F.when(F.col("p_partkey") % 5 == 0, png_chunk("caBX", F.lit(b"jumb"))).otherwise(none), png_chunk("IEND", none))


def png_files(spark, sf_dir) -> DataFrame:
    """A file for each part, every seventh cut short."""
    broken = F.when(F.col("p_partkey") % 7 == 0, F.substring(png_content(), 1, 30)).otherwise(png_content())
    return parts(spark, sf_dir).select("p_partkey", F.concat(F.lit("/i/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("path"), broken.alias("content"), F.lit(".png").alias("extension"))


def media_files(spark, sf_dir) -> DataFrame:
    """A file for each part, of five formats in turn: every second part has EXIF or user data, every third an XMP packet; JPEG comments and RTF authors are the part's name."""
    k, name, none = F.col("p_partkey"), F.col("p_name").cast("binary"), F.lit(b"")
    where = lambda n, x: F.when(k % n == 0, x).otherwise(none)
    size = lambda n, digits: F.unhex(F.lpad(F.hex(n), digits, "0"))
    segment = lambda marker, body: F.concat(F.lit(bytes([0xFF, marker])), size(F.octet_length(body) + 2, 4), body)
    riff = lambda kind, body: F.concat(F.lit(kind), size(F.octet_length(body), 2), F.lit(bytes(3)), body)
    box = lambda kind, *body: F.concat(size(F.octet_length(F.concat(none, *body)) + 8, 8), F.lit(kind), *body)
    jpeg = F.concat(F.lit(b"\xff\xd8"), where(2, segment(0xE1, F.lit(b"Exif\0\0x"))), where(3, segment(0xE1, F.lit(b"http://ns.adobe.com/xap/1.0/\0x"))), segment(0xFE, name), segment(0xDA, F.lit(bytes(6))), F.lit(b"scan\xff\xd9"))
    webp = F.concat(F.lit(b"RIFF\0\0\0\0WEBP"), riff(b"VP8 ", F.lit(b"data")), where(2, riff(b"EXIF", F.lit(b"abcd"))), where(3, riff(b"XMP ", F.lit(b"abcd"))))
    mp4 = F.concat(box(b"ftyp", F.lit(b"isom")), box(b"moov", box(b"mvhd", F.lit(b"x")), where(2, box(b"udta", name))), box(b"mdat", F.lit(b"film")))
    heif = F.concat(box(b"ftyp", F.lit(b"heic\0\0\0\0mif1heic")), box(b"meta", F.lit(bytes(4)), box(b"hdlr", F.lit(bytes(20))), where(2, box(b"Exif", name)), where(3, box(b"uuid", F.lit(XMP_UUID + b"x")))), box(b"mdat", F.lit(b"image")))
    rtf = F.concat(F.lit(rb"{\rtf1{\info{\author "), name, F.lit(b"}}text}"))
    formats = [(".jpg", jpeg), (".webp", webp), (".mp4", mp4), (".heic", heif), (".rtf", rtf)]
    pick = lambda values: F.element_at(F.array(*values), (k % len(formats) + 1).cast("int"))
    ext = pick([F.lit(e) for e, _ in formats])
    return parts(spark, sf_dir).select(F.concat(F.lit("/m/"), k.cast("string"), ext).alias("path"), pick([c for _, c in formats]).alias("content"), ext.alias("extension"))


def media_inspect(spark, sf_dir):
    return files.inspect_files(media_files(spark, sf_dir)).select("path", "container", "key", "value", "error_code")


def media_clean(spark, sf_dir):
    out = files.clean_files(media_files(spark, sf_dir))
    return out.select("path", F.size("cleaned.removed").alias("removed"), (F.col("cleaned.input_bytes") - F.col("cleaned.output_bytes")).alias("bytes_less"), "cleaned.error_code")


def image_regions(spark, sf_dir):
    """A grey picture of 24 by 24 for each part, with a half-transparent box by its key."""
    n, k = 24, F.col("p_partkey")
    x, y, w, h = (k % 7).cast("int"), (k % 5).cast("int"), (k % 11 + 2).cast("int"), (k % 13 + 2).cast("int")
    pixels = lambda colour, times: F.repeat(F.lit(colour), times)
    row, cut = pixels("808080FF", F.lit(n)), F.concat(pixels("808080FF", x), pixels("8080805A", w), pixels("808080FF", n - x - w))
    data = F.unhex(F.concat(F.repeat(row, y), F.repeat(cut, h), F.repeat(row, n - y - h)))
    image = F.struct(data.alias("data"), F.lit(n).alias("height"), F.lit(n).alias("width"), F.lit(4).alias("nChannels"))
    found = parts(spark, sf_dir).select("p_partkey", F.explode(detect_regions(image)).alias("r"))
    return found.select("p_partkey", "r.*")


def png_inspect(spark, sf_dir):
    return files.inspect_files(png_files(spark, sf_dir)).select("path", "container", "key", "value", "error_code")


def png_clean(spark, sf_dir):
    out = files.clean_files(png_files(spark, sf_dir))
    return out.select("path", "output_path", F.size("cleaned.removed").alias("removed"), (F.col("cleaned.input_bytes") - F.col("cleaned.output_bytes")).alias("bytes_less"), "cleaned.error_code")


def mixed_files(spark, sf_dir) -> DataFrame:
    """Markdown, text, pages and files that no reader takes; of the pictures every second is one, and no office file is."""
    k = F.col("p_partkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".md", ".PNG", ".txt", "", ".exe", ".html", ".tar.gz", ".Docx")]), (k % 8 + 1).cast("int"))
    text = F.concat(F.lit("# "), F.col("p_name"), F.lit("\n")).cast("binary")
    return parts(spark, sf_dir).select(F.concat(F.lit("/in.d/"), k.cast("string"), ext).alias("path"), F.when(k % 16 == 1, png_content()).otherwise(text).alias("content"))


def classify_files(spark, sf_dir):
    p = F.col("path")
    return mixed_files(spark, sf_dir).select("path", classify(p).alias("pipeline"), is_supported(p).alias("supported"), output_path(p).alias("output_path"))


def batch_outcomes(spark, sf_dir):
    return files.outcomes(files.clean_all(mixed_files(spark, sf_dir)))


def written_files(spark, sf_dir):
    """A mixed batch, cleaned, written as files and read again."""
    folder, listing = new_folder(spark, "cleaned-files"), new_folder(spark, "cleaned-names")
    write_files(files.clean_all(mixed_files(spark, sf_dir)), folder, base="/in.d", listing=listing)
    found = read_files(spark.read.schema(LISTING).parquet(listing), folder)
    return found.select(F.regexp_extract("name", "([^/]*)$", 1).alias("name"), "length", F.md5("content").alias("content_md5"))


def custom_signals(spark, sf_dir):
    """Passages of the benchmark as detectors of the caller's: where its items have got into documents."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.lit("benchmark").alias("vendor"), F.col("item_id").cast("string").alias("pattern"), F.lit(1.0).alias("confidence"), F.array_join(F.slice(F.split("text", " "), 1, 8), " ").alias("literal"))
    registry = detectors.Registry(()).with_table(items)
    return text.signal_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["lang"], registry=registry)


def custom_matches(spark, sf_dir):
    """Two detectors of the caller's beside the others: their matches in planted texts."""
    registry = detectors.REGISTRY.with_detectors(detectors.Detector.of_literal("Editor", "heading", 0.5, "# Head"), detectors.Detector("Editor", "rule", 0.4, r"\*{3,}"))
    return text.detect_text(documents(spark, sf_dir), registry=registry.only("Editor")).select("doc_id", "pattern", "confidence", "position", "length")


def events_of(spark, sf_dir, kind: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter(F.col("event_type") == kind)


def last_click(spark, sf_dir):
    """Each purchase with the last click of its user before it."""
    found = asof_join(events_of(spark, sf_dir, "purchase").select("event_id", "user_id", "ts"), events_of(spark, sf_dir, "click"), ["user_id"], "ts", "ts", ["event_id", "value"], bucket=6 * 3_600_000_000)
    return found.select("event_id", "user_id", F.col("asof_event_id").alias("click_id"), F.col("asof_value").alias("click_value"))


def purchases_after_errors(spark, sf_dir):
    """Purchases of a user within twelve hours of an error, with each such error."""
    errors = events_of(spark, sf_dir, "error").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("since"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("until"))
    found = interval_join(events_of(spark, sf_dir, "purchase"), errors, ["user_id"], "ts", "since", "until", bucket=600_000_000)
    return found.select(F.col("point.event_id").alias("event_id"), F.col("interval.error_id").alias("error_id"))


def turn_tokens(spark, sf_dir):
    """Template tokens that are cut by turns, by the table function in SQL; every even turn ends in half a token and every odd one starts with the rest."""
    tables.register(spark)
    even = F.col("turn") % 2 == 0
    text = F.concat(F.when(even, "").otherwise("ST] "), F.coalesce("text", F.lit("")), F.when(even, " [IN").otherwise(""))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", text.alias("text"))
    return spark.sql("SELECT conv_id, started, ended, token FROM turn_tokens(TABLE({turns}), 'conv_id', 'turn', 'text') WHERE cut", turns=turns)


def lateral_matches(spark, sf_dir):
    """Matches by language and pattern, with the table function beside each row in SQL."""
    tables.register(spark)
    sql = "SELECT lang, vendor, pattern, count(*) AS matches, count(DISTINCT doc_id) AS texts FROM {docs} AS d, LATERAL text_matches(d.text) GROUP BY ALL"
    return spark.sql(sql, docs=documents(spark, sf_dir))


def signals_by_label(spark, sf_dir):
    t = F.col("text")
    hit = documents(spark, sf_dir).select("doc_id", "source", (hygiene.count_invisible(t) > 0).alias("hidden"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return hit.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("documents"), F.sum(F.col("hidden").cast("long")).alias("with_hidden"))


def top_sources(spark, sf_dir):
    """The five sources with the most invisible characters for their documents; a top-k report."""
    per = documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.sum(hygiene.count_invisible(F.col("text"))).alias("invisible"))
    return per.withColumn("rate", F.round(F.col("invisible") / F.col("documents"), 6)).orderBy(F.desc("rate"), "source").limit(5)


def conversation_tokens(spark, sf_dir):
    """Template tokens by turn, and how many the conversation had before."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", planted(F.col("conv_id") + F.col("turn"), F.col("text")).alias("text"))
    d = next(d for d in detectors.DETECTORS if d.pattern == "template-leak")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    counted = turns.select("conv_id", "turn", "role", d.count(F.col("text")).alias("tokens"))
    return counted.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))


def signal_rollup(spark, sf_dir):
    """Texts are read once, by language and source; the levels above add up sums."""
    t = F.col("text")
    per = documents(spark, sf_dir).groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum(hygiene.count_invisible(t)).alias("i"), F.sum(hygiene.count_substituted(t)).alias("s"))
    return per.rollup("lang", "source").agg(F.sum("n").alias("documents"), F.sum("i").alias("invisible"), F.sum("s").alias("substituted"))


def signal_bursts(spark, sf_dir):
    """Sessions of matches by source, with a minute of event time between documents; a gap of half an hour ends one."""
    texts = documents(spark, sf_dir).withColumn("at", F.timestamp_seconds(F.col("doc_id") * 60))
    found = bursts(texts, "at", ["source"], gap="1830 seconds")
    return found.select("source", F.col("session.start").cast("long").alias("session_start"), F.col("session.end").cast("long").alias("session_end"), "matches")


def json_rows(spark, sf_dir):
    return as_json(documents(spark, sf_dir).select("doc_id", "lang", hygiene.count_invisible(F.col("text")).alias("invisible")))


def stream_rates(spark, sf_dir):
    """Rates over documents read as a stream, a minute of event time apart."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    # a pattern, as a stream's path that isn't one must be a folder
    stream = read_stream(spark, f"{sf_dir}/documents.parque[t]", schema).select(F.timestamp_seconds(F.col("doc_id") * 60).alias("at"), planted(F.col("doc_id"), F.col("text")).alias("text"))
    folder = new_folder(spark, "stream-rates")

    def keep(rates: DataFrame, batch: int) -> None:
        rates.write.mode("overwrite").parquet(f"{folder}/rates")

    query = signal_rates(stream, "at", window="2 hours").writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rates").select(F.col("window.start").cast("long").alias("window_start"), "vendor", "pattern", "matches")


def event_budgets(spark, sf_dir):
    """Each user's first three events of a day, and how many came after them, over events read as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts").schema
    stream = read_stream(spark, f"{sf_dir}/events.parque[t]", schema)
    folder = new_folder(spark, "event-budgets")
    found = budgets(stream, ["user_id"], "ts", "event_id", permits=3, window_seconds=86_400)
    found.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        hygiene_strip, hygiene_substitute, hygiene_confidence, hygiene_nfkc, hygiene_log, codepoint_inventory, collapse_whitespace, word_tokens,
        signal_counts, detect_text, clean_text, remove_controls, remove_markup, markdown_lines, markdown_blocks, markdown_clean, markdown_strip_all,
        markdown_detect, markdown_segments, html_metadata, png_inspect, png_clean, media_inspect, media_clean, image_regions, classify_files, batch_outcomes, written_files, custom_signals, custom_matches, last_click, purchases_after_errors, turn_tokens, lateral_matches, signals_by_label, top_sources,
        conversation_tokens, signal_rollup, signal_bursts, json_rows, stream_rates, event_budgets,
    ]
    return {f.__name__: f for f in found}
