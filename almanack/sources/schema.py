"""The one event schema, and its construction from partial rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almanack.functions import text

_DDL = (
    "event_id string, seq long, title string, description string, date date, start_time string, end_time string,"
    "location struct<name:string,address:string,neighborhood:string,lat:double,lng:double>, categories array<string>,"
    "source string, source_url string, image_url string, image_hash long, extra_images array<string>, price string, scraped_at timestamp,"
    "organizer string, organizer_url string, organizer_refs array<struct<platform:string,external_id:string,name:string,url:string,role:string,handle:string>>,"
    "account string, likes long, comments long, video_views long, account_followers long, account_verified boolean, is_pinned boolean,"
    "user_saved boolean, user_tagged boolean, user_affinity boolean, user_following boolean, account_yield double, account_posts long, affinity_comentions long,"
    "evergreen boolean, is_story boolean, is_highlight boolean, discovered_via string, attendance_signal long, discovery_lane string, reasons array<string>,"
    "recurring boolean, series_id string, contributing_sources array<string>, contributing_accounts array<string>, first_seen_at timestamp, engagement_delta long, score long, highlights array<string>"
)


def event() -> T.StructType:
    """The schema; it needs a session."""
    return T.StructType.fromDDL(_DDL)


def one_of_each(refs: Column) -> Column:
    """The first organiser of each platform and id there."""
    name = lambda r: F.concat_ws("|", F.coalesce(r["platform"], F.lit("")), F.coalesce(r["external_id"], r["url"], r["name"], F.lit("")))
    return F.filter(refs, lambda r, i: F.array_position(F.transform(refs, name), name(r)) == i + 1)


def conform(df: DataFrame) -> DataFrame:
    """``df`` in the event schema: missing columns are null, or empty where rows are merged; ids, prices and sources are filled in; images are capped at nine."""
    have, schema = set(df.columns), event()
    out = df.select(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields))
    return out.withColumns(
        {
            "event_id": F.coalesce("event_id", text.short_id(F.coalesce("source", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce(F.col("date").cast("string"), F.lit("")))),
            "price": F.coalesce("price", text.price_of(F.col("description"))),
            "categories": F.coalesce("categories", F.array().cast("array<string>")),
            "contributing_sources": F.coalesce("contributing_sources", F.array_compact(F.array("source"))),
            "contributing_accounts": F.coalesce("contributing_accounts", F.array_compact(F.array("account"))),
            "extra_images": F.slice(F.coalesce("extra_images", F.array().cast("array<string>")), 1, 9),
            "organizer_refs": one_of_each(F.coalesce("organizer_refs", F.array().cast(schema["organizer_refs"].dataType))),
        }
    )
