"""Schemas of the landed and the normalised tables."""

from __future__ import annotations

SIGNALS = """signal_id long, ts timestamp, country_code string, latitude double, longitude double, sentiment double, source_url string,
source_name string, headline string, themes array<string>, persons array<string>, created_at timestamp, is_crisis boolean, crisis_score double,
crisis_themes array<string>, severity string, event_type string, source_family string, source_lang string, geo_confidence double,
attribution_method string, is_state_media boolean, source_origin_country string, signal_class string, nlp_sentiment double,
nlp_confidence double, nlp_framing string, nlp_persons array<struct<name:string,type:string>>, nlp_processed_at timestamp, nlp_method string"""

LOCATION = "struct<location_type:int,full_name:string,country_code:string,adm1:string,adm2:string,latitude:double,longitude:double,feature_id:string,char_offset:int>"
COUNT = f"struct<count_type:string,number:long,object_type:string,location:{LOCATION}>"
TONE = "struct<tone:double,positive_pct:double,negative_pct:double,polarity:double,activity_density:double,self_group_ref:double,word_count:int>"

CONFLICT_JSON = """event_id_cnty string, event_date string, event_type string, sub_event_type string, actor1 string, actor2 string, country string,
region string, location string, latitude string, longitude string, fatalities string, notes string, source string"""
PAGE_JSON = "items array<struct<project:string,articles:array<struct<article:string,views:long>>>>"
ARTICLE_JSON = "title string, link string, description string, pubDate string, country array<string>, language string, source string"



def column_names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names
