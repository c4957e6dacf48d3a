"""The given tables in web-analytics shape.

Events, orders and line items stand for the facts; users, pages and parts for
the dimensions. Attributes the tables lack are derived from ``props.k`` and the
ids by fixed rules, written here for Spark and in ``oracle.py`` for SQL. A
session is one user's day. Every view covers its whole table, and only the
joins a query asks for are in its plan.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitloom.operators.attribution import order_sql
from visitloom.operators.calendar import expand_weeks, weeks_near_july, with_fiscal
from visitloom.operators.joins import null_safe_join
from visitloom.sources.staging import new_path, stage
from visitloom.streaming.runs import EVERY_AGE

URL_TAILS = (
    "",
    "/jsp/offer/cm/us/common/cm_template_responsive.jsp?date=2024january",
    "/next/spring-sale",
    "/next/sale",
    "&promoCode=P4",
    "&gclid=g5",
    "&fbclid=f6",
    "/offer_temp5.jsp?code=N003",
    "/checkout/step/confirmation.jsp",
    "&irpid=9&clickid=c9&afsrc=1",
    "&irpid=10&clickid=c10",
    "/wine-blog/a",
    "/product/12",
    "/jsp/newlandingpage/us/home.jsp",
    "/newlandingpage/?code=N003",
    "/cm_template_responsive?date=Gifting",
)
SYSTEMS = ("iOS", "Android", "Macintosh", "Windows")
SOURCES = ("google", "facebook", None, "google", "bronto", "attentive", "cm_dm", None)
MEDIUMS = ("cpc", "paidsocial", None, "organic", "email", "sms", "postcard", "referral")
CAMPAIGNS = ("spring_std", "retargeting_a", "none", "event_b", "club_join")
ADS_CAMPAIGNS = ("Wine_BR_a", "b_nb", "PMax all", "Shopping A", "a-YT-b", None)
PAGE_TYPES = ("blog", "gifts", "wine club", "advent", "account", "home", "product detail")
FISCAL = ("fiscal_year", "fiscal_quarter_number", "fiscal_month_number", "fiscal_month_name",
          "fiscal_week_number", "fiscal_week_start_date", "fiscal_week_end_date")


def choose(values: tuple, number: str) -> str:
    """SQL for element ``number % len(values)`` of a fixed list."""
    listed = ", ".join("cast(null as string)" if v is None else f"'{v}'" for v in values)
    return f"get(array({listed}), cast(pmod({number}, {len(values)}) as int))"


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._read: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(self.path(name))
        return self._read[name]

    def path(self, name: str) -> str:
        """One file here, a folder of part files on a cluster."""
        return f"{self.sf_dir}/{name}.parquet"

    def files(self, name: str) -> str:
        """The path as a pattern: a stream takes a plain path for a folder."""
        return f"{self.sf_dir}/{name}.parque[t]"

    def stream(self, name: str) -> DataFrame:
        reader = self.spark.readStream.schema(self.table(name).schema).option("maxFileAge", EVERY_AGE)
        return reader.parquet(self.files(name))

    def stream_of(self, rows: DataFrame, files: int) -> DataFrame:
        """The rows as a stream of so many files, one batch each."""
        path = new_path(self.spark, "landed")
        rows.repartition(files).write.parquet(path)
        return self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def events(self, *, pages: bool = False, geo: bool = False) -> DataFrame:
        raw = self.table("events").selectExpr("*", "cast(get_json_object(props, '$.k') as int) as k")
        df = raw.selectExpr(
            "event_id",
            "user_id as user_pseudo_id",
            "user_id * 100000 + datediff(ts, date'2000-01-01') as session_id",
            "cast(ts as date) as event_date",
            "ts as event_timestamp_utc",
            """case event_type when 'view' then 'page_view' when 'signup' then 'sign_up'
               when 'error' then 'user_engagement' else event_type end as event_name""",
            "k",
            "value",
            "concat('B', user_id % 3) as brand",
            "concat('www.b', user_id % 3, '.example') as host",
            f"{choose(SYSTEMS, 'k')} as device_operating_system",
            f"{choose(('desktop', 'Mobile', 'tablet'), 'k')} as device_category",
            f"{choose(('Soft Logged-In', 'Hard Logged-In', 'Unidentified', None, None), 'k')} as login_status",
            f"{choose(SOURCES, 'k')} as source",
            f"{choose(MEDIUMS, 'k')} as medium",
            "case when k % 6 = 0 then 0L else floor(value * 1000) end as engagement_time_msec",
            "concat('P', k % 10) as promo_code",
            f"{choose(('CONFIRM CANCELLATION', 'SUBMIT FEEDBACK', 'OTHER'), 'k')} as event_category",
            "if(k % 4 < 2, concat('Free Shipping ', k % 5), 'Gift') as event_class",
            "concat('reason ', k % 7) as event_label",
            "concat('club ', user_id % 4) as event_order",
            "concat('/x/', user_id, '/', cast(ts as date)) as page_fragment",
            "k % 2 + 1 as page_number",
            "if(event_type = 'purchase', event_id, null) as transaction_id",
        )
        if pages:
            df = self._with_pages(df)
        if geo:
            df = self.with_geo(df)
        return df

    def _with_pages(self, df: DataFrame) -> DataFrame:
        # The page count is a scalar subquery in a projection: one row, and no
        # cross join. The join itself is left to Catalyst's size check; an event
        # whose page is not in the table stays, without a location.
        pages = self.table("pages").select("page_id", "url")
        count = pages.agg(F.count(F.lit(1)).alias("n")).scalar()
        keyed = df.withColumn("page_id", F.col("event_id") % count)
        located = keyed.join(pages, "page_id", "left").selectExpr(
            *df.columns, f"concat(url, {choose(URL_TAILS, 'k')}) as page_location"
        )
        return located.selectExpr(
            "*",
            r"""case k % 4 when 0 then '/' when 1 then '/jsp/homepage.jsp'
                else regexp_replace(page_location, '^https?://[^/]+', '') end as page_path""",
        )

    def with_geo(self, df: DataFrame) -> DataFrame:
        # One small look-up after the other, each joined by its own file size;
        # joined to each other first they would be estimated as a product.
        home = self.table("customer").selectExpr("c_custkey as user_pseudo_id", "c_nationkey")
        nation = self.table("nation").selectExpr("n_nationkey as c_nationkey", "n_name", "n_regionkey")
        area = self.table("region").selectExpr("r_regionkey as n_regionkey", "r_name")
        return (
            df.join(home, "user_pseudo_id", "left")
            .join(nation, "c_nationkey", "left")
            .join(area, "n_regionkey", "left")
            .selectExpr(
                *df.columns,
                "if(k % 17 <> 0, r_name, null) as country",
                "if(k % 17 <> 0, n_name, null) as region",
                "case when k % 11 = 1 then '' when k % 11 <> 0 then n_name end as city",
            )
        )

    def transactions(self) -> DataFrame:
        return (
            self.events()
            .where("event_name = 'purchase'")
            .selectExpr(
                "brand",
                "user_pseudo_id",
                "session_id",
                "transaction_id",
                "event_date as transaction_date",
                "event_timestamp_utc",
                "value as revenue",
            )
        )

    def sessions(self, *, pages: bool = True, geo: bool = True) -> DataFrame:
        """One row per session. Page and place are looked up for the first event
        only, after the events have shrunk to sessions; plans that need neither
        say so, because Catalyst cannot drop a join whose side may repeat a key."""
        keys = ["brand", "user_pseudo_id", "session_id"]
        # Fixed-width picks only, so that tasks hash the events and sort nothing:
        # the order holds the id of the first event, and names follow from ``k``.
        order = order_sql("event_timestamp_utc", "event_id")
        measures = {
            "session_date": "min(event_date)",
            "session_start_timestamp_utc": "min(event_timestamp_utc)",
            "session_duration_s": "timestampdiff(SECOND, min(event_timestamp_utc), max(event_timestamp_utc))",
            "engagement_time_msec": "sum(engagement_time_msec)",
            "purchases": "count_if(event_name = 'purchase')",
            "first_order": f"min({order})",
            "k": f"min_by(k, {order})",
            "source_k": f"min_by(k, {order}) filter (where source is not null)",
            "medium_k": f"min_by(k, {order}) filter (where medium is not null)",
        }
        visits = self.events().groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in measures.items()])
        looked_up = visits.selectExpr(
            *keys,
            *[m for m in measures if m not in ("first_order", "source_k", "medium_k")],
            "cast(first_order % 10000000000000000000 as bigint) as event_id",
            f"{choose(SYSTEMS, 'k')} as device_operating_system",
            f"{choose(SOURCES, 'source_k')} as source",
            f"{choose(MEDIUMS, 'medium_k')} as medium",
        )
        if pages:
            looked_up = self._with_pages(looked_up).withColumnRenamed("page_location", "landing_page_location")
        if geo:
            looked_up = self.with_geo(looked_up)
        derived = {
            "host": "concat('www.b', user_pseudo_id % 3, '.example')",
            "lnd_source": "coalesce(source, 'none')",
            "lnd_medium": "coalesce(medium, 'none')",
            "lnd_source_medium": "concat(coalesce(source, 'none'), ' / ', coalesce(medium, 'none'))",
            "lnd_campaign": choose(CAMPAIGNS, "session_id"),
            "lnd_content": "concat('content ', session_id % 3)",
            "ads_campaign_name": choose(ADS_CAMPAIGNS, "user_pseudo_id"),
            "landing_page_referrer": choose((None, "", "https://ref.example/"), "session_id"),
            "landing_page_type": choose(PAGE_TYPES, "session_id"),
            "url_campaign_id": "if(session_id % 4 = 0, 'c1', null)",
            "order_type": choose(("Club", "Non-Club"), "session_id"),
            "ga_session_number": """case when session_id % 13 = 0 then null
                when user_pseudo_id % 7 = 0 then 32 - dayofmonth(session_date) else dayofmonth(session_date) end""",
            "channel_category": """case coalesce(medium, 'none') when 'cpc' then 'Paid Search'
                when 'paidsocial' then 'Paid Social' when 'none' then 'Direct' else 'Other' end""",
            "marketing_category": "if(coalesce(medium in ('cpc', 'paidsocial'), false), 'Paid', 'Owned')",
        }
        if pages:
            for name in ("gclid", "wbraid", "fbclid"):
                found = f"regexp_extract(landing_page_location, '{name}=([^&]+)', 1)"
                derived[f"url_{name}"] = f"nullif({found}, '')"
        kept = [c for c in looked_up.columns if c not in ("event_id", "k", "page_path")]
        return looked_up.selectExpr(*kept, *[f"{e} as {n}" for n, e in derived.items()])

    def report(self, *, pages: bool = True, geo: bool = True, fiscal: bool = True) -> DataFrame:
        """Session x transaction, as reporting tables hold it.

        Written as sessions with a purchase, joined to their transactions, plus
        the other sessions; a hot session is then divided by AQE, which a left
        join would not allow. The join is null-safe so that both uses of the
        sessions share one shuffle (see ``split_left_join``).
        """
        sales = self.transactions().selectExpr("session_id", "transaction_id", "revenue as purchase_revenue")
        sessions = self.sessions(pages=pages, geo=geo).withColumnRenamed("session_date", "date")
        sold = null_safe_join(sessions.where("purchases > 0"), sales, ["session_id"])
        unsold = sessions.where("purchases = 0")
        rows = sold.unionByName(unsold, allowMissingColumns=True).drop("purchases")
        return with_fiscal(rows, "date", self.fiscal, list(FISCAL)) if fiscal else rows

    def stored_report(self) -> DataFrame:
        """The report as the stored table it stands for, for plans that read it
        more than once; only what journeys need of it."""
        columns = [
            "brand", "user_pseudo_id", "session_id", "transaction_id", "date",
            "session_start_timestamp_utc", "purchase_revenue", "ga_session_number",
            "lnd_source_medium", "marketing_category", "channel_category",
        ]
        return stage(self.report(pages=False, geo=False, fiscal=False).select(*columns))

    def orders(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey * 2 as order_id",
            "cast(o_orderdate as date) as order_date",
            """case o_orderstatus when 'F' then 'New Recruit' when 'O' then 'Existing Customer'
               when 'P' then 'Re-Recruit' end as customer_status""",
            "if(o_orderpriority = '5-LOW', 'Canceled', 'Invoiced') as sales_status",
            "if(o_custkey % 2 = 0, 'Wine Club', 'Non-Wine Club') as order_type",
            "concat('B', o_custkey % 3) as order_brand",
            "concat('R', o_custkey % 10) as response_code",
            "concat('C', o_orderkey % 5) as coupon_code",
            "concat('AX', o_orderkey) as ax_order_number",
            "o_orderpriority as media",
            "o_orderstatus as sales_activity",
            "o_custkey as customer_id",
            "o_totalprice as order_revenue",
        )

    def new_orders(self) -> DataFrame:
        return self.orders().where("customer_status = 'New Recruit' and sales_status = 'Invoiced'")

    def items(self) -> DataFrame:
        lines = self.table("lineitem").selectExpr("l_orderkey * 2 as transaction_id", "l_partkey as item_id")
        parts = self.table("part").selectExpr("p_partkey as item_id", "p_name as item_name")
        return lines.join(parts, "item_id")

    @cached_property
    def fiscal(self) -> DataFrame:
        """Fiscal days of all years that the events lie in."""
        return expand_weeks(self.fiscal_weeks())

    def fiscal_weeks(self) -> DataFrame:
        days = self.table("events").agg(F.min("ts"), F.max("ts")).first()
        first, last = (d or dt.datetime(2024, 1, 1) for d in days)
        return weeks_near_july(self.spark, first.year - 1, last.year)
