"""Local assets of HTML documents: which may be read, and documents with their assets within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import paths

# What a document may use, by media type, and the limits in bytes and assets.
MEDIA = {
    "css": "text/css", "js": "text/javascript", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon", "woff": "font/woff", "woff2": "font/woff2", "ttf": "font/ttf",
    "otf": "font/otf", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "webm": "video/webm",
}
ASSET_LIMIT, TOTAL_LIMIT, MOST = 8 << 20, 24 << 20, 160


def read_error(document: Column, asset: Column, size: Column, is_symlink: Column) -> Column:
    """Why a document may not read a file, the first rule that it breaks; null if it may."""
    hidden = lambda p: F.exists(F.split(p, "/"), lambda c: c.startswith("."))
    folder = paths.parent(document)
    inside = (folder == "") | asset.startswith(F.concat(folder, F.lit("/")))
    odd = lambda p: p.startswith("/") | F.exists(F.split(p, "/"), lambda c: c.isin("", "..", "."))
    return (
        F.when(~F.coalesce(document.rlike(r"(?i)\.html?$"), F.lit(False)), "not an HTML document")
        .when(F.coalesce(odd(document) | odd(asset), F.lit(True)), "invalid path")
        .when(hidden(document), "hidden")
        .when(~inside, "outside of the document's folder")
        .when(~paths.extension(asset).isin(*MEDIA), "unsupported type")
        .when(hidden(asset), "hidden")
        .when(F.coalesce(is_symlink, F.lit(False)), "symbolic link")
        .when(size.isNull(), "not a file")
        .when(size > ASSET_LIMIT, "too large")
    )


def references(documents: DataFrame) -> DataFrame:
    """(path, place, reference, target): what HTML documents (path, body) refer to, by attributes and styles, in order.

    ``target`` is the path below the root; null for what is no relative
    reference into the document's own folder. Data addresses are none.
    """
    pattern = r"""(?i)(?:\b(?:src|poster|xlink:href)\s*=\s*["']([^"']+)["']|<(?:link|image)\b[^>]*?\bhref\s*=\s*["']([^"']+)["']|url\(\s*["']?([^"')]+)["']?\s*\))"""
    found = F.array(*[F.regexp_extract_all("body", F.lit(pattern), F.lit(k)) for k in (1, 2, 3)])
    each = F.zip_with(F.zip_with(found[0], found[1], lambda a, b: F.concat(a, b)), found[2], lambda a, b: F.concat(a, b))
    rows = documents.select("path", F.posexplode(each).alias("place", "reference")).filter(~F.col("reference").rlike("(?i)^(?:data:|#)") & (F.trim("reference") != ""))
    plain = F.regexp_replace(F.trim("reference"), "[?#].*$", "")
    decoded = F.coalesce(F.try_url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), plain)
    local = ~F.trim("reference").rlike(r"(?i)^(?:[a-z][a-z\d+.-]*:|/)")
    folder = paths.parent(F.col("path"))
    target = paths.fold(F.concat_ws("/", F.nullif(folder, F.lit("")), decoded))
    safe = ~F.exists(F.split(decoded, "/"), lambda c: c.startswith(".") & ~c.isin(".", "..") | c.contains("\\")) & ((folder == "") | target.startswith(F.concat(folder, F.lit("/"))))
    return rows.select("path", "place", "reference", F.when(local & safe, target).alias("target"))


def audit(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, place, reference, target, state): whether each reference can be taken in, by the limits of a document.

    ``assets`` (path, size). Distinct files count once, in order: at most
    ``MOST`` and ``TOTAL_LIMIT`` bytes together, each of ``ASSET_LIMIT`` at
    most. States: ok, outside, missing, unsupported, too large, too many.
    """
    refs = references(documents)
    files = assets.select(F.col("path").alias("target"), "size")
    met = refs.filter("target is not null").groupBy("path", "target").agg(F.min("place").alias("first")).join(files, "target", "left")
    kind = paths.extension(F.col("target")).isin(*MEDIA)
    w = Window.partitionBy("path").orderBy("first")  # one document's files
    usable = kind & F.col("size").isNotNull()
    counted = met.withColumn("n", F.sum(usable.cast("long")).over(w)).withColumn("bytes", F.sum(F.when(usable, F.col("size")).otherwise(0)).over(w))
    state = (
        F.when(~kind, "unsupported").when(F.col("size").isNull(), "missing").when((F.col("size") > ASSET_LIMIT) | (F.col("bytes") > TOTAL_LIMIT), "too large").when(F.col("n") > MOST, "too many").otherwise("ok")
    )
    judged = counted.select("path", "target", state.alias("state"))
    return refs.join(judged, ["path", "target"], "left").select("path", "place", "reference", "target", F.coalesce("state", F.lit("outside")).alias("state"))


def bundled(documents: DataFrame, assets: DataFrame) -> DataFrame:
    """(path, body, warnings): documents with their usable files within, as data addresses; others become empty.

    ``assets`` (path, size, content). Scripts and styles are taken in the same
    way as images; links between documents and the page's own anchors stay.
    """
    judged = audit(documents, assets)
    content = assets.select(F.col("path").alias("target"), "content")
    media = F.create_map(*[F.lit(x) for kv in MEDIA.items() for x in kv])
    data = F.concat(F.lit("data:"), media[paths.extension(F.col("target"))], F.lit(";base64,"), F.base64("content"))
    held = judged.join(content, "target", "left").select("path", "reference", "place", F.when(F.col("state") == "ok", data).otherwise("").alias("data"), "state")
    entry = F.struct((-F.length("reference")).alias("n"), "place", "reference", "data", "state")
    per = held.groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("refs"))
    both = documents.select("path", "body").join(per, "path", "left")

    def put(body, r):
        for a, z in (('"', '"'), ("'", "'"), ("(", ")")):
            body = F.replace(body, F.concat(F.lit(a), r["reference"], F.lit(z)), F.concat(F.lit(a), r["data"], F.lit(z)))
        return body

    made = F.aggregate(F.coalesce("refs", F.array().cast(per.schema["refs"].dataType)), F.col("body"), put)
    lost = F.array_distinct(F.transform(F.filter("refs", lambda r: r["state"] != "ok"), lambda r: F.concat(F.lit("unavailable: "), r["reference"])))
    return both.select("path", made.alias("body"), F.coalesce(lost, F.array().cast("array<string>")).alias("warnings"))
