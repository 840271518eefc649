"""Writers: snapshot partitions, report folders, saved crawls and sitemaps."""

from __future__ import annotations

import gzip
import json
from html import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.operators.ranks import numbered
from webloom.sources.files import write_text

NAMESPACE, PER_FILE = "http://www.sitemaps.org/schemas/sitemap/0.9", 50_000  # fixed values of the protocol


def write_snapshots(pages: DataFrame, path: str) -> None:
    """One row per (run_id, url_id), the latest, into partitions by run; only the runs written are replaced."""
    best = pages.groupBy("run_id", "url_id").agg(F.max_by(F.struct(*pages.columns), "fetched_at").alias("b")).select("b.*")
    best.write.partitionBy("run_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def compact(pages: DataFrame) -> DataFrame:
    """Pages without their html; refuses while a page with html has no digest yet."""
    if pages.where("html is not null and content_hash_sha256 is null").limit(1).count():
        raise ValueError("some pages have html but no digest: compute the hashes first")
    return pages.drop("html")


def sitemap_files(urls: DataFrame, per_file: int = PER_FILE) -> DataFrame:
    """(file_no, xml) of the sorted distinct addresses, ``per_file`` a file.

    No task ever sees all addresses.
    """
    ranked = numbered(urls.select("url").where("url <> ''").distinct(), "url", "r").withColumn("file_no", F.floor(F.col("r") / per_file))
    entry = F.concat(F.lit("  <url><loc>"), F.replace(F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</loc></url>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", entry.alias("e")))), lambda x: x["e"]), "\n")  # per_file entries at most
    head = f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="{NAMESPACE}">\n'
    return ranked.groupBy("file_no").agg(F.concat(F.lit(head), body, F.lit("\n</urlset>\n")).alias("xml"))


def write_sitemap(urls: DataFrame, folder: str, stem: str = "sitemap", base: str = "", per_file: int = PER_FILE) -> list[str]:
    """Write the files, and an index if there is more than one; gives the names written.  Without an address nothing is."""
    spark, names = urls.sparkSession, []
    files = sitemap_files(urls, per_file).orderBy("file_no")
    n = files.count()
    for r in files.toLocalIterator():  # a file at a time
        name = f"{stem}.xml" if n == 1 else f"{stem}-{r.file_no + 1}.xml"
        write_text(spark, f"{folder}/{name}", r.xml)
        names.append(name)
    if n > 1:
        lines = "\n".join(f"  <sitemap><loc>{escape(base + x)}</loc></sitemap>" for x in names)
        write_text(spark, f"{folder}/{stem}.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="{NAMESPACE}">\n{lines}\n</sitemapindex>\n')
        names.append(f"{stem}.xml")
    return names


def write_reports(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a CSV folder with a header, and a manifest of their columns and rows."""
    manifest = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        manifest[name] = {"columns": df.columns, "rows": df.count()}
    for df in list(tables.values())[:1]:
        write_text(df.sparkSession, f"{folder}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))


def write_crawl(results: DataFrame, folder: str, summary: dict | None = None) -> None:
    """Results as JSON lines, a file per partition, and a last file with the summary line, if there is a summary."""
    results.write.mode("overwrite").json(folder)
    if summary is not None:
        write_text(results.sparkSession, f"{folder}/summary.json", json.dumps({"__type": "summary", **summary}) + "\n")


def chain_text(chain):
    """``url (301) -> url (200)`` of an array of struct(url, status)."""
    return F.array_join(F.transform(chain, lambda h: F.concat(h["url"], F.lit(" ("), h["status"].cast("string"), F.lit(")"))), " -> ")


def overlap_envelope(pages: DataFrame, pairs: DataFrame, clusters: DataFrame, meta: dict, floor: int | None = None, least: float = 0.9, most: int = 500_000) -> dict:
    """The JSON document of an overlap report: meta, summary, pages, pairs and clusters.

    With a ``floor``, from so many pages on only pairs of at least ``least`` are told, and that is said in the summary.  A
    report of more than ``most`` pages or pairs is no document for a browser and is an error.
    """
    n = pages.count()
    told = pairs.where(F.col("sim") >= least) if floor is not None and n >= floor else pairs
    total, shown = pairs.count(), told.count()
    if max(shown, n) > most:
        raise ValueError("too large for one document: write the tables instead")
    rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
    summary = {"pages": n, "pairs": total, "pairs_told": shown, "truncated": shown < total, "clusters": clusters.count()}
    return {"meta": meta, "summary": summary, "pages": rows(pages), "pairs": rows(told.orderBy(F.desc("sim"))), "clusters": rows(clusters)}


PAGE = """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Overlap</title><style>body{font:14px sans-serif;margin:2em}td,th{padding:.2em .6em;text-align:left;border-bottom:1px solid #ddd}input{margin:.5em 0;width:30em}</style></head>
<body><h1>Overlap</h1><p id="s"></p><input id="q" placeholder="part of an address"><table><thead><tr><th>similarity</th><th>a</th><th>b</th><th>relation</th></tr></thead><tbody id="t"></tbody></table>
<script id="d" type="application/json">@DATA@</script><script>
const d=JSON.parse(document.getElementById("d").textContent),q=document.getElementById("q"),t=document.getElementById("t");
document.getElementById("s").textContent=d.summary.pages+" pages, "+d.summary.pairs+" pairs, "+d.summary.clusters+" clusters";
const cell=x=>{const c=document.createElement("td");c.textContent=x==null?"":x;return c};
function draw(){t.replaceChildren(...d.pairs.filter(p=>!q.value||(p.url_a+p.url_b).includes(q.value)).slice(0,500).map(p=>{const r=document.createElement("tr");r.append(cell(p.sim),cell(p.url_a),cell(p.url_b),cell(p.relation));return r}))}
q.oninput=draw;draw();</script></body></html>
"""


def write_html(spark: SparkSession, envelope: dict, path: str) -> None:
    """One file that works offline; the data can't end the script it is in."""
    data = json.dumps(envelope, ensure_ascii=False).replace("<", "\\u003c")
    write_text(spark, path, PAGE.replace("@DATA@", data))


def packed_html(text: str) -> bytes:
    """Tagged gzip, as older stores keep pages."""
    return b"\x01" + gzip.compress(text.encode(), 6)


def unpacked_html(data: bytes | None) -> str:
    """Tagged gzip or plain UTF-8."""
    if not data:
        return ""
    return gzip.decompress(data[1:]).decode() if data[:1] == b"\x01" else data.decode()
