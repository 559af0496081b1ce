import pytest

from tableferry.plans.spec import Endpoint, SpecError
from tableferry.sources.objects import hadoop_settings, object_uri


def test_s3():
    ep = Endpoint("s3", {"region": "eu-west-1", "bucket": "b", "key": "dir/a.csv", "accessKeyId": "", "secretAccessKey": ""})
    assert object_uri(ep) == "s3a://b/dir/a.csv"
    assert hadoop_settings(ep) == {"fs.s3a.bucket.b.endpoint.region": "eu-west-1"}
    ep = Endpoint("s3", {"bucket": "b", "key": "a", "accessKeyId": "i", "secretAccessKey": "s"})
    assert hadoop_settings(ep) == {"fs.s3a.bucket.b.access.key": "i", "fs.s3a.bucket.b.secret.key": "s"}


def test_gcs():
    ep = Endpoint("gcs", {"bucket": "b", "key": "/a.csv", "projectId": "p", "keyFilename": "/k.json"})
    assert object_uri(ep) == "gs://b/a.csv"
    assert hadoop_settings(ep)["fs.gs.auth.service.account.json.keyfile"] == "/k.json"
    assert hadoop_settings(Endpoint("gcs", {"bucket": "b", "key": "a"})) == {}


def test_azure():
    text = "DefaultEndpointsProtocol=https;AccountName=acc;AccountKey=k==;EndpointSuffix=core.windows.net"
    ep = Endpoint("azureBlob", {"connectionString": text, "accountName": "other", "accountKey": "x", "container": "c", "blob": "d/a.csv"})
    assert object_uri(ep) == "abfss://c@acc.dfs.core.windows.net/d/a.csv"
    assert hadoop_settings(ep) == {"fs.azure.account.key.acc.dfs.core.windows.net": "k=="}
    ep = Endpoint("azureBlob", {"accountName": "other", "accountKey": "x", "container": "c", "blob": "a"})
    assert hadoop_settings(ep) == {"fs.azure.account.key.other.dfs.core.windows.net": "x"}
    with pytest.raises(SpecError, match="accountKey"):
        hadoop_settings(Endpoint("azureBlob", {"accountName": "a", "container": "c", "blob": "b"}))


def test_azure_suffix_endpoint_and_signature():
    text = "AccountName=acc;SharedAccessSignature=?sv=1&sig=a%3D;EndpointSuffix=core.chinacloudapi.cn"
    ep = Endpoint("azureBlob", {"connectionString": text, "container": "c", "blob": "a"})
    assert object_uri(ep) == "abfss://c@acc.dfs.core.chinacloudapi.cn/a"
    assert hadoop_settings(ep)["fs.azure.sas.fixed.token.acc.dfs.core.chinacloudapi.cn"] == "sv=1&sig=a%3D"
    text = "BlobEndpoint=https://acc.blob.core.windows.net/;AccountKey=k"
    ep = Endpoint("azureBlob", {"connectionString": text, "container": "c", "blob": "a"})
    assert object_uri(ep) == "abfss://c@acc.dfs.core.windows.net/a"
    with pytest.raises(SpecError, match="AccountKey"):
        object_uri(Endpoint("azureBlob", {"connectionString": "AccountName=a", "container": "c", "blob": "b"}))
