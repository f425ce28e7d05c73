"""Session settings that the library relies on."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "corpusflow", **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@dataclass(frozen=True)
class Config:
    """What a deployment must name (no default) and what it may."""

    search_endpoint: str
    index_name: str
    knowledge_source: str
    knowledge_base: str
    embedding_endpoint: str
    embedding_deployment: str
    query_endpoint: str
    query_deployment: str
    storage_account: str
    source_container: str
    state_container: str
    dimensions: int = 3072
    embedding_model: str = "text-embedding-3-large"
    environment: str = "Production"
    context_chars: int = 16000
    top_k: int = 10

    @classmethod
    def from_mapping(cls, values: dict[str, str]) -> Config:
        """All missing required keys are named in one error."""
        required = [f.name for f in fields(cls) if f.default is f.default_factory]
        missing = [k for k in required if not str(values.get(k) or "").strip()]
        if missing:
            raise ValueError("missing configuration: " + ", ".join(missing))
        known = {f.name: f for f in fields(cls)}
        return cls(**{k: int(v) if known[k].type == "int" else v for k, v in values.items() if k in known})
