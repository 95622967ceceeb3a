"""Declared schemas (as DDL), gates and limits; nothing is inferred from data."""

from __future__ import annotations

from dataclasses import dataclass, replace

EVENTS = (
    "event_id string, ord long, date_added timestamp, source_url string, "
    "geo struct<type:int,full_name:string,country_code:string,adm1_code:string,adm2_code:string,latitude:double,longitude:double,feature_id:string>"
)
MENTIONS = (
    "event_id string, ord long, event_time timestamp, mention_time timestamp, mention_type int, source_name string, identifier string, sentence_id int, in_raw_text boolean, confidence double, translation string"
)
DOCUMENTS = (
    "record_id string, ord long, published_at timestamp, collection int, common_name string, document_id string, translation string, title string"
)
EVIDENCE = "struct<article_id:string,url:string,quote:string,start:int,end:int,method:string>"
ARTICLES = (
    "article_id string, canonical_url string, url string, title string, summary string, outlet_id string, domain string, publisher_name string, language string, "
    "published_at timestamp, retrieved_at timestamp, provider string, provider_record_id string, provider_score double"
)
SEARCH_RESULTS = (
    "articles array<struct<url:string,title:string,seendate:string,domain:string,language:string,sourcecountry:string>>"
)
NEWS_RESULTS = (
    "results array<struct<title:string,url:string,content:string,published_date:string,score:double>>"
)
RUNS = (
    "run_id string, source string, status string, input_fingerprint string, started_at timestamp, completed_at timestamp, source_watermark_at timestamp, records_seen long, "
    "records_upserted long, error_kind string, error_message string, retryable boolean, receipt string, updated_at timestamp"
)

#: What can fail in a source.
FAILURES = ("timeout", "network", "http", "rate_limited", "auth", "invalid_response", "missing_key")


@dataclass(frozen=True)
class Gates:
    """Which mentions and documents count."""

    mention_type: int = 1
    in_raw_text: bool = True
    minimum_confidence: float = 80.0
    collection: int = 1


@dataclass(frozen=True)
class Limits:
    """Caps of a batch; each has a default and a hard bound."""

    events: int = 25_000
    mentions: int = 100_000
    documents: int = 100_000
    clusters: int = 200
    articles_per_cluster: int = 25

    HARD = {"events": 250_000, "mentions": 500_000, "documents": 500_000, "clusters": 500, "articles_per_cluster": 50}

    def resolve(self, **wanted: int) -> Limits:
        """These limits with others in place; a limit must be whole, positive and within its hard bound."""
        for name, value in wanted.items():
            if name not in self.HARD or isinstance(value, bool) or not isinstance(value, int) or not 0 < value <= self.HARD[name]:
                raise ValueError(f"{name} must be a whole number from 1 to {self.HARD.get(name)}")
        return replace(self, **wanted)
