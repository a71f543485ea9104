"""Connection settings: validation, environment variables, and the options that Spark's readers take for each system."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

# Defaults, required settings and environment variables of each system.
DEFAULT_PORTS = {"postgresql": 5432, "mysql": 3306}
ALIASES = {"postgres": "postgresql", "bq": "bigquery"}
REQUIRED = {
    "snowflake": ("host", "username", "password", "database"),
    "postgresql": ("host", "username", "password", "database"),
    "mysql": ("host", "username", "password", "database"),
    "bigquery": ("database",),
    "databricks": ("host",),
    "parquet": ("path",),
    "csv": ("path",),
    "table": (),
    "jdbc": ("url",),
}
ENVIRONMENT = {
    "snowflake": {"host": "SNOWFLAKE_ACCOUNT", "username": "SNOWFLAKE_USER", "password": "SNOWFLAKE_PASSWORD", "database": "SNOWFLAKE_DATABASE"},
    "postgresql": {"host": "POSTGRES_HOST", "username": "POSTGRES_USER", "password": "POSTGRES_PASSWORD", "database": "POSTGRES_DATABASE"},
    "mysql": {"host": "MYSQL_HOST", "username": "MYSQL_USER", "password": "MYSQL_PASSWORD", "database": "MYSQL_DATABASE"},
    "bigquery": {"database": "BIGQUERY_PROJECT_ID", "schema": "BIGQUERY_DATASET", "credentials_path": "BIGQUERY_CREDENTIALS_PATH"},
    "databricks": {"host": "DATABRICKS_HOST", "access_token": "DATABRICKS_TOKEN", "http_path": "DATABRICKS_HTTP_PATH"},
}
OPTIONAL = {
    "snowflake": {"schema": ("SNOWFLAKE_SCHEMA", "PUBLIC"), "warehouse": ("SNOWFLAKE_WAREHOUSE", "COMPUTE_WH"), "role": ("SNOWFLAKE_ROLE", None), "authenticator": ("SNOWFLAKE_AUTHENTICATOR", "snowflake")},
    "postgresql": {"port": ("POSTGRES_PORT", "5432"), "schema": ("POSTGRES_SCHEMA", "public"), "ssl_mode": ("POSTGRES_SSL_MODE", "prefer")},
    "mysql": {"port": ("MYSQL_PORT", "3306"), "charset": ("MYSQL_CHARSET", "utf8mb4")},
    "bigquery": {"location": ("BIGQUERY_LOCATION", "US")},
    "databricks": {"catalog": ("DATABRICKS_CATALOG", "main"), "schema": ("DATABRICKS_SCHEMA", "default")},
}


@dataclass(frozen=True)
class Config:
    """Settings of one source. extra holds what only some systems know."""

    system: str
    host: str | None = None
    port: int | None = None
    database: str | None = None
    schema: str | None = None
    username: str | None = None
    password: str | None = field(default=None, repr=False)
    path: str | None = None
    url: str | None = None
    extra: Mapping = field(default_factory=dict, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "system", ALIASES.get(self.system.lower(), self.system.lower()))
        if self.system not in REQUIRED:
            raise ValueError(f"Unsupported data source: {self.system}")

    def validate(self) -> Config:
        """This, if every check of CHECKS holds; otherwise an error that tells of all that fail."""
        found = [f"{self.system} needs {name}" for name in REQUIRED[self.system] if not str(getattr(self, name) or "").strip()]
        found += [f"{name} {said}: {value!r}" for name, wrong, said in CHECKS if (value := getattr(self, name)) is not None and wrong(value)]
        if found:
            raise ValueError(", ".join(found))
        return self


#: What a setting must not be, and how that is told.
CHECKS = (
    ("port", lambda v: isinstance(v, bool) or not isinstance(v, int) or v not in range(1, 65536), "is no port number"),
    ("host", lambda v: len(v.split()) > 1, "holds white space"),
)


def missing_variables(system: str, env: Mapping = os.environ) -> list[str]:
    return [v for k, v in ENVIRONMENT[ALIASES.get(system, system)].items() if not env.get(v) and not (system == "bigquery" and k == "credentials_path")]


def from_environment(system: str, env: Mapping = os.environ, prefix: str = "") -> Config:
    """Settings from variables; with a prefix such as SOURCE_ each side of a comparison can have its own."""
    system = ALIASES.get(system, system)
    get = lambda name, default=None: env.get(prefix + name, env.get(name, default))
    found = {k: get(v) for k, v in ENVIRONMENT[system].items()} | {k: get(v, d) for k, (v, d) in OPTIONAL[system].items()}
    if "port" in found:
        found["port"] = int(found["port"])
    own = {k: found.pop(k) for k in list(found) if k in Config.__dataclass_fields__}
    return Config(system, **own, extra={k: v for k, v in found.items() if v is not None}).validate()


def snowflake_account(host: str | None) -> str:
    """The account in a host name, an address or a bare identifier."""
    name = (host or "").strip()
    if not name:
        raise ValueError("Host is required")
    name = name.split("://")[-1].split("/")[0].split(":")[0]
    account, domain, _ = name.partition(".snowflakecomputing.com")
    if domain and not account:
        raise ValueError("Invalid account: host contains only domain")
    if not domain and (not account or "." in account or " " in account):
        raise ValueError(f"Invalid account identifier: {account}")
    return account


def bigquery_credentials(extra: Mapping, env: Mapping = os.environ) -> dict:
    """A key file first, then key material, then the environment's file, else the machine's own identity (no option)."""
    import base64
    import json

    if extra.get("credentials_path"):
        return {"credentialsFile": extra["credentials_path"]}
    if extra.get("service_account_info"):
        return {"credentials": base64.b64encode(json.dumps(extra["service_account_info"]).encode()).decode()}
    if env.get("GOOGLE_APPLICATION_CREDENTIALS"):
        return {"credentialsFile": env["GOOGLE_APPLICATION_CREDENTIALS"]}
    return {}


def databricks_token(config: Config, env: Mapping = os.environ) -> str | None:
    """An access token first, then the password, then the environment, then an identity provider's token."""
    return config.extra.get("access_token") or config.password or env.get("DATABRICKS_TOKEN") or config.extra.get("azure_ad_token")


def reader_options(config: Config, table: str | None = None, query: str | None = None) -> tuple[str, dict]:
    """Format and options with which spark.read loads a table or query. The drivers themselves are not part of this library."""
    config.validate()
    x, system = dict(config.extra), config.system
    what = {"query": query} if query else {"dbtable": table} if table else {}
    login = {k: v for k, v in (("user", config.username), ("password", config.password)) if v is not None}
    split = {k: str(x[k]) for k in ("partitionColumn", "lowerBound", "upperBound", "numPartitions", "fetchsize", "driver") if k in x}
    if system == "postgresql":
        url = f"jdbc:postgresql://{config.host}:{config.port or DEFAULT_PORTS[system]}/{config.database}?sslmode={x.get('ssl_mode', 'prefer')}&currentSchema={config.schema or 'public'}"
        return "jdbc", {"url": url, **login, **what, **split}
    if system == "mysql":
        url = f"jdbc:mysql://{config.host}:{config.port or DEFAULT_PORTS[system]}/{config.database}?connectionCollation={x.get('charset', 'utf8mb4')}_general_ci"
        return "jdbc", {"url": url, **login, **what, **split}
    if system == "jdbc":
        return "jdbc", {"url": config.url, **login, **what, **split}
    if system == "snowflake":
        options = {"sfURL": f"{snowflake_account(config.host)}.snowflakecomputing.com", "sfUser": config.username, "sfPassword": config.password, "sfDatabase": config.database, "sfSchema": config.schema or "PUBLIC", "sfWarehouse": x.get("warehouse"), "sfRole": x.get("role")}
        return "snowflake", {k: v for k, v in options.items() if v is not None} | what
    if system == "bigquery":
        named = {"query": query} if query else {"table": f"{config.database}.{config.schema}.{table}" if config.schema and table and "." not in table else table}
        return "bigquery", {"parentProject": config.database, "location": x.get("location", "US"), **bigquery_credentials(x), **{k: v for k, v in named.items() if v}}
    if system == "databricks":
        url = f"jdbc:databricks://{config.host}:443/default;httpPath={x.get('http_path', '')};AuthMech=3;ConnCatalog={x.get('catalog', 'main')};ConnSchema={config.schema or 'default'}"
        token = databricks_token(config)
        return "jdbc", {"url": url, "user": "token", **({"password": token} if token else {}), **what, **split}
    raise ValueError(f"{system} is not read by options")
