"""Posts, raw items, prompts and plans derived from the test tables by SQL that both engines run.

``{S}`` is the text type and ``{table}`` a test table. Each view covers its whole table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlens import fixed_values as fixed
from postlens.config import tune

AS_OF = 1_706_745_600  # 2024-02-01T00:00:00Z
SINCE = AS_OF - fixed.SECONDS_PER_MONTH

# Every document is a post with its whole text. Each benchmark item adds two posts, one in another script and one too
# short, so that both tests of a text drop rows.
POSTS = """
select concat('p', cast(doc_id as {S})) as id,
       concat('r/', source) as community,
       cast(1704067200 + (doc_id * 7919) % 2592000 as bigint) as created_utc,
       substr(text, 1, 60) as title,
       concat(substr(text, 61), case doc_id % 6
         when 0 then '. I wish there was a better export; please'
         when 1 then '. I tried the app but it crashed twice. I can''t log in'
         when 2 then '. It doesn''t work because sync is broken'
         when 3 then '! This is NOT better, it is very STUPID but pathetic!!'
         else '' end) as selftext,
       cast((doc_id * 7919) % 503 as int) as upvotes,
       cast((doc_id * 104729) % 97 as int) as num_comments,
       concat('https://posts.example/', cast(doc_id as {S})) as url
from {documents}
union all
select concat('p', cast(10000000000 + 2 * item_id as {S})), concat('r/src', cast(item_id % 20 as {S})),
       cast(1704067200 + (item_id * 6007) % 2592000 as bigint), 'Привет всем', 'Это сообщение написано по-русски, а не по-английски',
       cast(item_id % 503 as int), cast(item_id % 97 as int), concat('https://posts.example/items/', cast(item_id as {S}))
from {benchmark}
union all
select concat('p', cast(10000000001 + 2 * item_id as {S})), concat('r/src', cast(item_id % 20 as {S})),
       cast(1704067201 + (item_id * 6007) % 2592000 as bigint), 'Hi', '',
       cast(item_id % 503 as int), cast(item_id % 97 as int), concat('https://posts.example/items/', cast(item_id as {S}))
from {benchmark}
"""

# A third of the items lacks a link, one in fifty a score; every tenth item comes again, older and changed.
RAW = """
select id, replace(community, 'r/', '') as subreddit, cast(created_utc as double) as created_utc, title, selftext,
       case cast(substr(id, 2) as bigint) % 3 when 0 then null when 1 then '' else url end as full_link,
       case when cast(substr(id, 2) as bigint) % 50 = 0 then null else cast(upvotes as bigint) end as score,
       cast(num_comments as bigint) as num_comments
from {posts}
union all
select id, replace(community, 'r/', ''), cast(created_utc - 1 as double), title, concat('again ', selftext), url,
       cast(upvotes as bigint), cast(num_comments as bigint)
from {posts} where cast(substr(id, 2) as bigint) % 10 = 0
"""

# Every turn of every conversation is a prompt; a tail adds words the lookup tables know.
PROMPTS = """
select conv_id * 100 + turn as plan_id,
       concat(text, case (conv_id + turn) % 8
         when 0 then ' haptic glove market'
         when 1 then ' sentiment review of a meditation app'
         when 2 then ' mobil uygulama güvenlik'
         when 3 then ' competitor alternative vs'
         when 4 then ' idea for ai productivity'
         when 5 then ' uygulamalar marketteki "yapay zeka" it''s'
         when 6 then ' anxiety trend ''voice control'''
         else '' end) as prompt,
       case conv_id % 4
         when 0 then '"face reading" trash'
         when 1 then 'stupid pathetic Stupid'
         when 2 then 'en er ai'
         else '' end as keywords,
       case conv_id % 3 when 0 then 'market' else 'auto' end as report_type,
       case conv_id % 5
         when 0 then 'r/src3, SRC3 r/all'
         when 1 then 'x/r/src7,src8 src9 src10 src11 src12 src13 src14 src15'
         when 2 then 'AskReddit r/all'
         when 3 then 'r/AskReddit,src2'
         else '' end as communities,
       case turn % 3 when 0 then 'export,Log In,EXPORT, ' when 1 then 'sync is broken' else '' end as must_terms,
       case conv_id % 2 when 0 then 'trash,scum' else 'Trash' end as should_terms,
       case turn % 2 when 0 then 'idiot' else '' end as exclude_terms,
       case conv_id % 7 when 0 then 'thin data,Thin data,old posts' else '' end as warnings,
       case conv_id % 4 when 0 then 'seed warning,Seed Warning' else '' end as seed_warnings,
       case turn % 4 when 0 then 'Privacy' when 1 then '' else 'Cost' end as theme,
       case conv_id % 3 when 0 then 'slow,crash,price,bugs' when 1 then 'lag' else '' end as pains
from {conversations}
"""

PROFILES = """
select community, n % 7 = 3 as over18, case when n % 5 = 4 then null else n * 1500 end as subscribers
from (select distinct concat('r/', source) as community, cast(replace(source, 'src', '') as bigint) as n
      from {documents}) s
"""

#: Plans used where posts are searched: communities, keywords, excludes, months, score, limit.
SEARCH_PLANS = [
    (1, ["r/src1", "r/src2", "r/src3"], ["trash", "export"], ["idiot"], 1, 20, 200),
    (2, ["r/src0", "r/src4"], [], ["scum"], 1, 50, 30),
    (3, ["r/src5"], ["sync is broken", "log in", "Log In"], [], 1, 0, 2000),
    (4, ["r/nowhere"], ["worthless"], [], 2, 100, 100),
]

#: Prompts used where posts are searched for evidence and for communities.
SEARCH_PROMPTS = [
    (1, "haptic glove market", "", "market"),
    (2, "sentiment review of a meditation app", '"face reading" trash', "sentiment"),
    (3, "mobil uygulama kullanici", "", "auto"),
    (4, "the of and", "", "faq"),
    (5, "", "", "faq"),
    (6, "competitor alternative vs", "stupid pathetic", "sentiment"),
    (7, "idea for ai productivity", "en er ai", "ideation"),
    (8, "better export please", "disgusting", "trend"),
    (9, "zzzz qqqq vrxx", "", "faq"),
]

STOP = "the and of to in is on it that with be at by for".split()


def duck(sql: str) -> str:
    """The text of a view for DuckDB, tables by their own name."""
    for name in ("documents", "conversations", "posts", "embeddings", "benchmark"):
        sql = sql.replace("{" + name + "}", name)
    return sql.replace("{S}", "varchar")


class Inputs:
    """The derived views as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, sql: str, **tables: DataFrame) -> DataFrame:
        return self.spark.sql(sql.replace("{S}", "string"), **tables)

    @cached_property
    def posts(self) -> DataFrame:
        return self.view(POSTS, documents=self.table("documents"), benchmark=self.table("benchmark"))

    @cached_property
    def raw(self) -> DataFrame:
        return self.view(RAW, posts=self.posts)

    @cached_property
    def prompts(self) -> DataFrame:
        return self.view(PROMPTS, conversations=self.table("conversations"))

    @cached_property
    def profiles(self) -> DataFrame:
        return self.view(PROFILES, documents=self.table("documents"))

    @cached_property
    def synonyms(self) -> DataFrame:
        return fixed.synonym_table(self.spark)

    @cached_property
    def lexicon(self) -> DataFrame:
        return fixed.lexicon_table(self.spark)

    @cached_property
    def plans(self) -> DataFrame:
        """Nested plans, one per prompt."""
        text_list = lambda name: F.filter(F.split(name, ","), lambda x: x != "")
        theme = F.struct(
            F.col("theme").alias("name"), F.lit("").alias("audience"), text_list("pains").alias("pain_points"),
            text_list("must_terms").alias("desired_outcomes"),
        )
        return self.prompts.select(
            "plan_id", "prompt",
            F.filter(F.split("communities", "[, ]+"), lambda x: x != "").alias("communities"),
            F.struct(F.lit(1).alias("months"), F.lit(20).alias("min_upvotes"), F.lit(100).alias("limit")).alias("params"),
            F.struct(
                F.filter(F.split(F.replace("keywords", F.lit('"'), F.lit("")), " "), lambda x: x != "").alias("keywords"),
                text_list("must_terms").alias("must_include"), text_list("should_terms").alias("should_include"),
                text_list("exclude_terms").alias("exclude"), F.array(F.lit("en")).alias("languages"),
            ).alias("filters"),
            "report_type",
            F.filter(F.split(F.replace("keywords", F.lit('"'), F.lit("")), " "), lambda x: x != "").alias("keywords"),
            text_list("warnings").alias("warnings"), text_list("seed_warnings").alias("seed_warnings"),
            F.when(F.col("pains") != "", F.array(theme, theme)).alias("topic_themes"),
        )

    @cached_property
    def search_plans(self) -> DataFrame:
        rows = [(p, "|".join(c), "|".join(k), "|".join(x), m, u, n) for p, c, k, x, m, u, n in SEARCH_PLANS]
        flat = fixed.inline_table(self.spark, "plan_id, communities, keywords, exclude, months, min_upvotes, lim", rows)
        text_list = lambda name: F.filter(F.split(name, r"\|"), lambda x: x != "")
        return flat.select(
            F.col("plan_id").cast("long").alias("plan_id"), text_list("communities").alias("communities"),
            F.struct("months", "min_upvotes", F.col("lim").alias("limit")).alias("params"),
            F.struct(text_list("keywords").alias("keywords"), text_list("exclude").alias("exclude")).alias("filters"),
        )

    @cached_property
    def all_search_plans(self) -> DataFrame:
        """A plan to search posts with, for every prompt of the table."""
        text_list = lambda *names: F.filter(F.split(F.concat_ws(",", *names), ","), lambda x: x != "")
        return self.prompts.select(
            "plan_id", F.filter(F.split("communities", "[, ]+"), lambda x: x != "").alias("communities"),
            F.struct(F.lit(1).alias("months"), F.lit(20).alias("min_upvotes"), F.lit(40).alias("limit")).alias("params"),
            F.struct(text_list("must_terms", "should_terms").alias("keywords"), text_list("exclude_terms").alias("exclude")).alias("filters"),
        )

    @cached_property
    def search_prompts(self) -> DataFrame:
        flat = fixed.inline_table(self.spark, "plan_id, prompt, keywords, report_type", SEARCH_PROMPTS)
        return flat.withColumn("plan_id", F.col("plan_id").cast("long"))

    @cached_property
    def evidence_plans(self) -> DataFrame:
        return self.evidence_plans_of(self.search_prompts)

    @staticmethod
    def evidence_plans_of(prompts: DataFrame) -> DataFrame:
        """A plan to gather evidence with, for each prompt."""
        empty = F.array().cast("array<string>")
        return prompts.select(
            "plan_id", "prompt", F.array(F.lit("r/src1"), F.lit("r/src2")).alias("communities"),
            F.struct(F.lit(1).alias("months"), F.lit(20).alias("min_upvotes"), F.lit(100).alias("limit")).alias("params"),
            F.struct(
                F.split(F.replace("keywords", F.lit('"'), F.lit("")), " ").alias("must_include"),
                empty.alias("should_include"), empty.alias("exclude"), empty.alias("languages"), empty.alias("keywords"),
            ).alias("filters"),
            "report_type", empty.alias("keywords"), empty.alias("warnings"),
            F.lit(None).cast(
                "array<struct<name:string,audience:string,pain_points:array<string>,desired_outcomes:array<string>>>"
            ).alias("topic_themes"),
        )
