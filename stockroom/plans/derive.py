"""Inputs derived from the given tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _case(of: str, values: list[str]) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


CATALOGUE = f"""
SELECT p_partkey AS row_seq, concat('brand_', CAST(p_partkey % 4 AS STRING), '.csv') AS source_file,
  {_case("p_partkey % 5", ["LG", "Bosch", "Samsung", " lg ", "Haier"])} AS brand,
  {_case("p_partkey % 7", ["Cooking", "Dishwashing", "Refrigeration", " cooking ", "REFRIGERATION", "Laundry", ""])} AS product_group,
  {_case("CAST(floor(p_partkey / 7) AS BIGINT) % 13", ["Built-in Microwave", "Microwave Oven", "Freestanding Cooker", "Steam Oven", "Induction Hob", "Gas Cooktop", "Ceramic Cooktop", " Canopy Hood ", "Bottom Mount Freezer", "Chest Freezer", "Wine Cabinet", "Specialty", ""])} AS subcategory,
  concat(p_name, {_case("p_partkey % 6", [" Freezer", " Wine Cabinet", " Fridge", "", " Beverage", " Oven"])}) AS product_name,
  CASE WHEN p_partkey % 50 = 0 THEN '' ELSE concat('SKU-', CAST(p_partkey AS STRING)) END AS sku,
  CASE WHEN p_partkey % 10 = 0 THEN '' ELSE concat('https://shop.example.com/p/', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING), CASE WHEN p_partkey % 2 = 0 THEN '/' ELSE '' END) END AS link
FROM part"""

PAIRS = f"""
SELECT k AS page_key, i AS seq,
  {_case("(k + 5 * i) % 12", ["Net Dimension (W x H x D) (mm)", "Product Dimensions (WxHxD)", "Width (mm)", "Height (cm)", "Depth (mm)", "Cutout Dimension (W x H x D) (mm)", "Gross Dimension W*D*H (cm)", "Depth with handle (mm)", "Energy rating", "Overall cavity width", "Gross Dimension", "Unit dimension (D×W×H)"])} AS label,
  CASE (7 * k + i * i + CAST(floor(k / 12) AS BIGINT)) % 6 WHEN 0 THEN concat(CAST(500 + p_size AS STRING), ' x ', CAST(800 + p_size AS STRING), ' x 600')
    WHEN 1 THEN '59.5 x 85 x 60' WHEN 2 THEN '85 - 90' WHEN 3 THEN '1,785' WHEN 4 THEN 'n/a' ELSE '600' END AS value
FROM (SELECT p_partkey AS k, p_size FROM part) p CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) n"""

CACHE_LOG = """
SELECT concat('https://shop.example.com/p/', CAST(user_id AS STRING)) AS url_key, event_id AS ord, ts AS fetched_at,
  CASE event_type WHEN 'purchase' THEN 'Resolved' WHEN 'view' THEN 'Needs Review' WHEN 'click' THEN 'Needs Review' ELSE 'Not Found' END AS confidence,
  CASE WHEN event_type = 'purchase' THEN CAST(event_id % 900 + 100 AS STRING) ELSE '' END AS height,
  CASE WHEN event_type = 'purchase' THEN CAST(event_id % 800 + 100 AS STRING) ELSE '' END AS width,
  CASE WHEN event_type = 'purchase' THEN CAST(event_id % 700 + 100 AS STRING) ELSE '' END AS depth,
  concat('https://shop.example.com/p/', CAST(user_id AS STRING)) AS source_url, event_type AS raw_text, '' AS reason
FROM events"""

CRAWL = """
SELECT url, CASE page_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 404 END AS status,
  CASE WHEN page_id % 6 = 5 THEN 'timeout' ELSE '' END AS error, html FROM pages"""

#: The same with the page that each capture is of: several pages may have one address.
PAGE_CRAWL = CRAWL.replace("SELECT url,", "SELECT page_id, url,")

CAPTURES = """
SELECT page_id, url, k, CASE (page_id + k) % 4 WHEN 0 THEN 200 WHEN 1 THEN 500 WHEN 2 THEN 200 ELSE 404 END AS status, '' AS error, concat(html, CASE k WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'xx' END) AS html,
  CAST(CASE k WHEN 0 THEN '2024-04-01 00:00:00' WHEN 1 THEN '2024-05-01 00:00:00' ELSE CASE page_id % 3 WHEN 0 THEN '2024-05-01 00:00:00' WHEN 1 THEN '2024-05-20 00:00:00' ELSE '2024-07-01 00:00:00' END END AS TIMESTAMP) AS fetched_at
FROM pages CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 1 UNION ALL SELECT 2) n WHERE page_id % 7 <> 0"""

NUMBERS = """
SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_retailprice * 1e17 WHEN 1 THEN p_retailprice * 1e20 WHEN 2 THEN -1 * p_retailprice * 1e30 WHEN 3 THEN p_size / 1e20 WHEN 4 THEN -1 * p_size / 1e5
  WHEN 5 THEN p_partkey * 1e7 + 0.5 WHEN 6 THEN p_size * 1e22 ELSE p_size / 1e3 END AS value FROM part"""

GRID = f"""
SELECT source_file, CAST(row_number() OVER (PARTITION BY source_file ORDER BY row_seq) + 4 AS BIGINT) AS row_idx, brand, product_group, subcategory, sku, product_name, link
FROM ({CATALOGUE}) c"""


def derived(spark: SparkSession, sf_dir: str, sql: str, by: str | None = None) -> DataFrame:
    """A derived table; ``sql`` names tables of ``sf_dir``. Rows of part are dealt out: few bytes in a file or two, and much work each.

    ``by``: a column of part that they are dealt out by, to as many tasks as a shuffle has. What is grouped by it later isn't shuffled again.
    """
    names = [t for t in ("part", "events", "pages") if f"FROM {t}" in sql]
    text = sql.replace("{", "{{").replace("}", "}}")
    for t in names:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names}
    if "part" in tables:
        cores = spark.sparkContext.defaultParallelism
        tables["part"] = tables["part"].repartition(max(cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), by) if by else tables["part"].repartition(cores)
    return spark.sql(text, **tables)
