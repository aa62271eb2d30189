"""Push notifications of four hosts, decoded by a table of JSON paths, and the decision on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHANGE = "struct<name: string, target: struct<hash: string>>"
#: All that is read of a payload, in one pass over it (fixed values).
PAYLOAD = f"""ref string, before string, after string, checkout_sha string, forced string, created string, deleted string, total_commits_count string, object_kind string, eventType string,
    repository struct<full_name: string, clone_url: string, links: struct<html: struct<href: string>>>, project struct<git_http_url: string>, commits array<string>,
    push struct<changes: array<struct<new: {_CHANGE}, old: {_CHANGE}>>>, resource struct<refUpdates: array<struct<name: string, newObjectId: string, oldObjectId: string>>, repository: struct<remoteUrl: string>>"""
#: Fixed values: (signal, ref, sha, before, location) of each host's payload.
PROVIDERS = {
    "github": ("repository.full_name", "ref", "after", "before", "repository.clone_url"),
    "gitlab": ("object_kind", "ref", "checkout_sha", "before", "project.git_http_url"),
    "bitbucket": ("push", "push.changes[0].new.name", "push.changes[0].new.target.hash", "push.changes[0].old.target.hash", "repository.links.html.href"),
    "azure": ("eventType", "resource.refUpdates[0].name", "resource.refUpdates[0].newObjectId", "resource.refUpdates[0].oldObjectId", "resource.repository.remoteUrl"),
}
COMMIT_CAP = 20
CHAIN_CAP = 10
SHA = "^[0-9a-f]{40}$"


def decode(raw: DataFrame, body: str = "body") -> DataFrame:
    """Adds provider, ref, sha, before, location, commits and whether the list of files can be trusted; no provider: not translatable."""
    read = raw.withColumn("pushed", F.from_json(F.col(body), PAYLOAD))
    at = _path
    host = F
    for name, (signal, _, sha, _, _) in PROVIDERS.items():
        host = host.when(at(signal).isNotNull() & at(sha).rlike(SHA), name)
    out = read.withColumn("provider", host.otherwise(None))
    for i, field in enumerate(("ref", "sha", "before", "location"), 1):
        pick = F
        for name, paths in PROVIDERS.items():
            pick = pick.when(F.col("provider") == name, at(paths[i]))
        out = out.withColumn(field, pick.otherwise(None))
    n = F.coalesce(F.size(at("commits")), F.lit(0))
    n = F.when(n > 0, n).otherwise(0)
    total = at("total_commits_count").try_cast("int")
    forced = F.coalesce(at("forced") == "true", F.lit(False)) | F.coalesce(at("created") == "true", F.lit(False)) | F.coalesce(at("deleted") == "true", F.lit(False))
    short = (n < COMMIT_CAP) & (n > 0)
    whole = F.when(F.col("provider") == "github", ~forced & short).when(F.col("provider") == "gitlab", (total.isNull() | (total == n)) & short).otherwise(False)
    return out.withColumn("commits", n).withColumn("complete", whole).drop("pushed")


def _path(path: str) -> Column:
    """A field of the payload; what isn't there is null."""
    out = F.col("pushed")
    for name in path.split("."):
        field, _, index = name.partition("[")
        out = out.getField(field)
        if index:
            out = F.get(out, F.lit(int(index[:-1])))
    return out


def inert(complete: Column, added: Column, removed: Column, modified: Column, readable: Column) -> Column:
    """Whether a push can't have changed what rules read: a trusted list of modified files only, none of them readable text."""
    return F.coalesce(complete & (added == 0) & (removed == 0) & (modified > 0) & (readable == 0), F.lit(False))


def verdict(provider: Column, decision: Column) -> Column:
    """The decision on a push, or that it couldn't be translated."""
    return F.when(provider.isNull(), "no_traducible").otherwise(decision)
