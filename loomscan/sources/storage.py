"""How object stores are reached: pyarrow's file systems from plain settings.

Settings are texts by name, so they travel as reader options and with tasks:

s3.access_key, s3.secret_key, s3.session_token   credentials; without them those of the environment or the machine
s3.region, s3.endpoint                           endpoint as a URL or host
s3.anonymous, s3.virtual_addressing              true or false; bucket names go into host names unless the second is false
s3.ca_file                                       certificates to trust
s3.request_timeout, s3.connect_timeout           seconds
s3.max_attempts                                  tries of a request
gs.anonymous, gs.access_token, gs.credential_file, gs.endpoint, gs.project, gs.retry_seconds
az.account_name, az.account_key, az.sas_token, az.client_id, az.client_secret, az.tenant_id, az.endpoint
az.connection_string                             account, key and endpoint in one; what is set singly wins

What isn't set is taken from LOOMSCAN_S3_REGION and the like, and then from the usual variables of each store. Unknown names
are errors.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import lru_cache

from pyarrow import fs

NAMES = {
    "s3": ("access_key", "secret_key", "session_token", "region", "endpoint", "anonymous", "virtual_addressing", "ca_file", "request_timeout", "connect_timeout", "max_attempts"),
    "gs": ("anonymous", "access_token", "credential_file", "endpoint", "project", "retry_seconds"),
    "az": ("account_name", "account_key", "sas_token", "client_id", "client_secret", "tenant_id", "endpoint", "connection_string"),
}
#: Variables that each store's own tools read. pyarrow reads S3's keys and Google's default credentials from them by itself.
USUAL = {
    ("s3", "endpoint"): ("AWS_ENDPOINT_URL_S3", "AWS_ENDPOINT_URL"),
    ("s3", "region"): ("AWS_REGION", "AWS_DEFAULT_REGION"),
    ("s3", "ca_file"): ("AWS_CA_BUNDLE",),
    ("az", "account_name"): ("AZURE_STORAGE_ACCOUNT_NAME",),
    ("az", "account_key"): ("AZURE_STORAGE_ACCOUNT_KEY",),
    ("az", "sas_token"): ("AZURE_STORAGE_SAS_TOKEN",),
    ("az", "connection_string"): ("AZURE_STORAGE_CONNECTION_STRING",),
}


class StorageError(ValueError):
    """Settings that a store can't be reached with."""


def flag(name: str, text: str) -> bool:
    if text.lower() not in ("true", "false", "1", "0"):
        raise StorageError(f"{name} must be true or false, not {text!r}")
    return text.lower() in ("true", "1")


def number(name: str, text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not 0 < value < float("inf"):
        raise StorageError(f"{name} must be a positive number, not {text!r}")
    return value


def settings(scheme: str, given: Mapping[str, str] | None = None, environment: Mapping[str, str] | None = None) -> dict[str, str]:
    """The settings of one store by name without its prefix: given ones, then the environment's."""
    environment = os.environ if environment is None else environment
    for name in given or {}:
        kind, _, rest = name.partition(".")
        if rest not in NAMES.get(kind, ()):
            raise StorageError(f"unknown storage setting {name!r}")
    found = {}
    for name in NAMES[scheme]:
        places = [environment.get(v) for v in (f"LOOMSCAN_{scheme}_{name}".upper(), *USUAL.get((scheme, name), ()))]
        value = next((x for x in [(given or {}).get(f"{scheme}.{name}"), *places] if x), None)
        if value is not None:
            found[name] = str(value)
    return found


def _host(url: str) -> tuple[str | None, str]:
    """The scheme, if it has one, and the host of an endpoint."""
    scheme, mark, rest = url.partition("://")
    return (scheme, rest.rstrip("/")) if mark else (None, url.rstrip("/"))


def s3_arguments(found: dict[str, str]) -> dict:
    """Arguments of pyarrow's S3 file system."""
    if ("access_key" in found) != ("secret_key" in found):
        raise StorageError("s3.access_key and s3.secret_key go together")
    args: dict = {k: found[k] for k in ("access_key", "secret_key", "session_token", "region") if k in found}
    if flag("s3.anonymous", found.get("anonymous", "false")):
        args = {"anonymous": True} | {k: v for k, v in args.items() if k == "region"}
    if "endpoint" in found:
        scheme, args["endpoint_override"] = _host(found["endpoint"])
        args |= {"scheme": scheme} if scheme else {}
        # other than the store's own, servers are addressed by path unless told otherwise
        args["force_virtual_addressing"] = flag("s3.virtual_addressing", found.get("virtual_addressing", "false"))
    if "ca_file" in found:
        args["tls_ca_file_path"] = found["ca_file"]
    for name in ("request_timeout", "connect_timeout"):
        if name in found:
            args[name] = number(f"s3.{name}", found[name])
    if "max_attempts" in found:
        args["retry_strategy"] = fs.AwsStandardS3RetryStrategy(max_attempts=int(number("s3.max_attempts", found["max_attempts"])))
    return args


def gs_arguments(found: dict[str, str]) -> dict:
    """Arguments of pyarrow's Google file system."""
    from datetime import datetime, timedelta, timezone

    args: dict = {}
    if flag("gs.anonymous", found.get("anonymous", "false")):
        args["anonymous"] = True
    elif "access_token" in found:
        args |= {"access_token": found["access_token"], "credential_token_expiration": datetime.now(timezone.utc) + timedelta(hours=1)}
    elif "credential_file" in found:  # read by the library from this variable only
        os.environ["GOOGLE_APPLICATION_CREDENTIALS"] = found["credential_file"]
    if "endpoint" in found:
        scheme, args["endpoint_override"] = _host(found["endpoint"])
        args |= {"scheme": scheme} if scheme else {}
    if "project" in found:
        args["project_id"] = found["project"]
    if "retry_seconds" in found:
        args["retry_time_limit"] = timedelta(seconds=number("gs.retry_seconds", found["retry_seconds"]))
    return args


def az_arguments(found: dict[str, str]) -> dict:
    """Arguments of pyarrow's Azure file system."""
    parts = dict(x.split("=", 1) for x in found.get("connection_string", "").split(";") if "=" in x)
    whole = {"account_name": parts.get("AccountName"), "account_key": parts.get("AccountKey"), "sas_token": parts.get("SharedAccessSignature"), "endpoint": parts.get("BlobEndpoint")}
    found = {k: v for k, v in whole.items() if v} | found
    if "account_name" not in found:
        raise StorageError("az:// needs az.account_name, az.connection_string or AZURE_STORAGE_ACCOUNT_NAME")
    args = {k: found[k] for k in ("account_name", "account_key", "sas_token", "client_id", "client_secret", "tenant_id") if k in found}
    if "account_key" in args and "sas_token" in args:
        del args["sas_token"]
    if "endpoint" in found:
        scheme, host = _host(found["endpoint"])
        args["blob_storage_authority"] = args["dfs_storage_authority"] = host
        if scheme:
            args["blob_storage_scheme"] = args["dfs_storage_scheme"] = scheme
    return args


_KINDS = {"s3": ("S3FileSystem", s3_arguments), "gs": ("GcsFileSystem", gs_arguments), "az": ("AzureFileSystem", az_arguments)}


@lru_cache(maxsize=32)
def _opened(scheme: str, found: tuple[tuple[str, str], ...]) -> fs.FileSystem:
    kind, arguments = _KINDS[scheme]
    if not hasattr(fs, kind):
        raise StorageError(f"no file system for {scheme}:// in this installation of pyarrow")
    return getattr(fs, kind)(**arguments(dict(found)))


def object_store(scheme: str, given: Mapping[str, str] | None = None) -> fs.FileSystem:
    """The file system of s3, gs or az under the settings, one for each set of them in a process."""
    return _opened(scheme, tuple(sorted(settings(scheme, given).items())))
