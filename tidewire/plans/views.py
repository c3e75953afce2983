"""Article views over the driver's tables, in SQL that Spark and DuckDB both run.

The driver's prose holds almost none of the words that the rules look for, so titles, excerpts and publishers are dealt
from fixed templates by a document's number; lengths, languages, sources and counts come from the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Templates.
TITLES = (
    "OpenAI launches GPT-5 with new reasoning benchmark results",
    "OpenAI unveils GPT-5 model for enterprise agents - Reuters",
    "GPT-5 pricing: OpenAI cuts subscription cost for GPT-5 tier, launch continues",
    "Anthropic releases Claude 3.5 Sonnet for coding agents",
    "Google DeepMind Gemini 2.0 debut beats MMLU benchmark | The Verge",
    "NVIDIA Blackwell B200 enters mass production at TSMC datacenter foundry",
    "SK Hynix HBM3E supply agreement with NVIDIA announced",
    "EU AI Act compliance deadline: regulation fines explained",
    "Copyright lawsuit against OpenAI and Microsoft in New York court",
    "Mistral AI raises funding at 6 billion valuation, series B investment",
    "Meta AI open weights Llama 3.3 released on Hugging Face",
    "How to use Cursor and Devin: beginner guide to coding",
    "NeurIPS call for papers deadline - TechCrunch",
    "삼성전자 HBM3E 반도체 양산 발표",
    "[속보] 네이버 하이퍼클로바X 공개",
    "Runway Gen-3 and Sora video gen comparison (updated)",
    "AMD MI300X partnership with Microsoft, joint initiative",
    "AISI and NIST safety evaluation finds jailbreak vulnerability in o1",
    "Anthropic hires executive from OpenAI; resignation confirmed",
    "OpenAI opens Seoul office, headquarters expansion",
    "Stanford HAI paper on arXiv: breakthrough benchmark for robotics",
    "Proud to announce our award-winning workflow productivity suite",
    "Local weather and sports digest",
    "Perplexity acquisition talks: merger investigation in Brussels",
)
EXCERPTS = (
    "The company announced the release and shared early results with partners in San Francisco.",
    "Analysts expect a billion in capex for new datacenter capacity and GPU supply.",
    "Regulators in Europe opened a probe; copyright and safety remain open questions.",
    "",
    "Developers can try the model with vLLM and Ollama, with fine-tuning support.",
    "An overview of the policy debate in Washington and London.",
    "서울에서 열린 행사에서 공개되었다.",
    "The paper describes multimodal vision and voice AI systems for humanoid robotics.",
    "Shares rose after the funding news in Tokyo and Taiwan.",
    "Researchers warned of prompt injection and data breach risks.",
    "A short note about nothing in particular.",
)
PUBLISHERS = (
    "Reuters", "Reuters Technology", "REUTERS", "reuters.com", "OpenAI", "OpenAI Blog", "TechCrunch AI", "The Verge", "Bloomberg News", "arXiv", "Hacker News",
    "Google News Global AI", "NIST", "AI타임스", "Random Gazette", "Hugging Face Blog", "Financial Times",
)
TYPES = ("media", "media", "media", "media", "official", "official", "media", "media", "media", "research", "community", "aggregator", "regulator", "korean_media", "media", "open_source", "media")
BUCKETS = ("frontier_models", "big", "hardware_infra", "conference", "nonsense", "research_breakthroughs", "industry_vc")
REF = "2026-09-17 12:00:00"


def deal(values: tuple[str, ...], number: str) -> str:
    joined = "~".join(v.replace("'", "''") for v in values)
    return f"split_part('{joined}', '~', CAST({number} % {len(values)} AS INT) + 1)"


#: doc_id, seq, title, excerpt, publisher, source, source_type, bucket, url, published_s (seconds), source_authority.
ARTICLES = f"""
SELECT doc_id, doc_id AS seq,
  {deal(TITLES, 'doc_id')} || CASE WHEN doc_id % 5 = 0 THEN ' in 2026' WHEN doc_id % 7 = 0 THEN ' v2 update' ELSE '' END AS title,
  {deal(EXCERPTS, 'CAST(floor(doc_id / 3) AS BIGINT)')} AS excerpt,
  {deal(PUBLISHERS, 'CAST(floor(doc_id / 2) AS BIGINT)')} AS publisher,
  {deal(PUBLISHERS, 'CAST(floor(doc_id / 2) AS BIGINT)')} AS source,
  {deal(TYPES, 'CAST(floor(doc_id / 2) AS BIGINT)')} AS source_type,
  {deal(BUCKETS, 'CAST(floor(doc_id / 5) AS BIGINT)')} AS bucket,
  'https://news.example.com/' || source || '/' || CAST(CAST(floor(doc_id / 2) AS BIGINT) * 2 + CASE WHEN doc_id % 11 = 0 THEN 0 ELSE doc_id % 2 END AS STRING) AS url,
  CASE WHEN doc_id % 13 = 0 THEN NULL ELSE 1789646400 - (doc_id * 7919) % 600000 END AS published_s,
  CASE WHEN doc_id % 4 = 0 THEN 70 WHEN doc_id % 4 = 1 THEN NULL ELSE CAST(60 + doc_id % 41 AS INT) END AS source_authority
FROM documents
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run a query over frames by name, without registering views."""
    marked = sql
    for name in tables:
        marked = re.sub(rf"\b(FROM|JOIN) {name}\b", rf"\1 {{{name}}}", marked)
    return spark.sql(marked, **tables)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view, with ``published_at``."""
    rows = run_sql(spark, ARTICLES, documents=table(spark, sf_dir, "documents").select("doc_id", "source"))
    return rows.withColumn("published_at", F.timestamp_seconds("published_s"))


def ref_time():
    return F.to_timestamp(F.lit(REF))
