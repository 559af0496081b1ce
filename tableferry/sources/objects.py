"""CSV objects in S3, Google Cloud Storage and Azure Blob Storage."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession

from tableferry.plans.spec import Endpoint, SpecError
from tableferry.sources.csv import read_csv

OBJECT_TYPES = ("s3", "gcs", "azureBlob")


def connection_parts(text: str) -> dict[str, str]:
    """Key=value parts of an Azure connection string; values may hold '='."""
    parts = (p.split("=", 1) for p in text.split(";") if "=" in p)
    return {k.strip(): v.strip() for k, v in parts}


def _azure_account(ep: Endpoint) -> tuple[str, str | None, str | None, str]:
    """Account, key, shared access signature and host; a connection string wins over the single fields."""
    if not ep.get("connectionString"):
        account = ep.need("accountName")
        return account, ep.need("accountKey"), None, f"{account}.dfs.core.windows.net"
    parts = connection_parts(ep.get("connectionString"))
    host = urlsplit(parts.get("BlobEndpoint", "")).hostname
    account = parts.get("AccountName") or (host or "").split(".")[0]
    key, signature = parts.get("AccountKey"), parts.get("SharedAccessSignature")
    if not account:
        raise SpecError("connection string lacks AccountName")
    if not key and not signature:
        raise SpecError("connection string lacks AccountKey")
    if host:
        host = host.replace(".blob.", ".dfs.", 1)
    else:
        host = f"{account}.dfs.{parts.get('EndpointSuffix', 'core.windows.net')}"
    return account, key, signature, host


def object_uri(ep: Endpoint) -> str:
    if ep.type == "s3":
        return f"s3a://{ep.need('bucket')}/{ep.need('key').lstrip('/')}"
    if ep.type == "gcs":
        return f"gs://{ep.need('bucket')}/{ep.need('key').lstrip('/')}"
    *_, host = _azure_account(ep)
    return f"abfss://{ep.need('container')}@{host}/{ep.need('blob').lstrip('/')}"


def hadoop_settings(ep: Endpoint) -> dict[str, str]:
    """File system settings that carry the endpoint's credentials.

    Without credentials in the config the cluster's own default chain is used.
    S3 settings are per bucket, Azure settings per account, so endpoints with
    different credentials can be used by one session.
    """
    if ep.type == "s3":
        base = f"fs.s3a.bucket.{ep.need('bucket')}"
        out = {}
        if ep.get("region"):
            out[f"{base}.endpoint.region"] = ep.get("region")
        if ep.get("accessKeyId") and ep.get("secretAccessKey"):
            out[f"{base}.access.key"] = ep.get("accessKeyId")
            out[f"{base}.secret.key"] = ep.get("secretAccessKey")
        return out
    if ep.type == "gcs":
        out = {}
        if ep.get("projectId"):
            out["fs.gs.project.id"] = ep.get("projectId")
        if ep.get("keyFilename"):
            out["fs.gs.auth.type"] = "SERVICE_ACCOUNT_JSON_KEYFILE"
            out["fs.gs.auth.service.account.json.keyfile"] = ep.get("keyFilename")
        return out
    _, key, signature, host = _azure_account(ep)
    if key:
        return {f"fs.azure.account.key.{host}": key}
    return {
        f"fs.azure.account.auth.type.{host}": "SAS",
        f"fs.azure.sas.fixed.token.{host}": signature.lstrip("?"),
    }


def connect(spark: SparkSession, ep: Endpoint) -> str:
    """Hand the credentials to the session's file systems and give the URI."""
    conf = spark._jsc.hadoopConfiguration()
    for key, value in hadoop_settings(ep).items():
        conf.set(key, str(value))
    return object_uri(ep)


def read_object_csv(spark: SparkSession, uri: str, multiline: bool | str = True) -> DataFrame:
    """Like ``read_csv``, but a row with the wrong number of cells is an error."""
    return read_csv(spark, uri, multiline=multiline, strict_rows=True)
