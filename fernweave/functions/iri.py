"""Identifiers as column expressions: percent-encoded segments below one namespace."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GraphConfig


def seg(c: Column) -> Column:
    """A path segment, percent-encoded with no safe characters but letters, digits and -._~."""
    return F.replace(F.replace(F.replace(F.url_encode(c.cast("string")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def resource(cfg: GraphConfig, kind: str, *parts: Column) -> Column:
    """cfg.resource + kind, then the parts, already encoded."""
    out = [F.lit(cfg.resource + kind)]
    for p in parts:
        out += [F.lit("/"), p]
    return F.concat(*out)


class Iris:
    """Identifiers of each kind of node for a namespace; arguments are columns."""

    def __init__(self, cfg: GraphConfig):
        self.cfg = cfg

    def _r(self, kind: str, *parts: Column) -> Column:
        return resource(self.cfg, kind, *parts)

    def onto(self, name: str) -> Column:
        return F.lit(self.cfg.onto + name)

    def run(self, run_id: Column) -> Column:
        return self._r("run", run_id)

    def run_graph(self, run_id: Column) -> Column:
        return self._r("graph/run", seg(run_id))

    def repo(self, slug: Column) -> Column:
        return self._r("repo", seg(slug))

    def commit(self, slug: Column, sha: Column) -> Column:
        return self._r("commit", seg(slug), sha)

    def file(self, slug: Column, path: Column) -> Column:
        return self._r("file", seg(slug), seg(path))

    def doc(self, slug: Column, path: Column) -> Column:
        return self._r("doc", seg(slug), seg(path))

    def pull(self, slug: Column, number: Column) -> Column:
        return self._r("pr", seg(slug), number.cast("string"))

    def repo_issue(self, slug: Column, number: Column) -> Column:
        return self._r("issue", seg(slug), number.cast("string"))

    def issue(self, key: Column) -> Column:
        return self._r("issue", seg(key))

    def comment(self, key: Column, ordinal: Column) -> Column:
        return self._r("comment", seg(key), ordinal.cast("string"))

    def pull_comment(self, slug: Column, number: Column, kind: str, cid: Column) -> Column:
        """kind: comment, review-comment or review-body; each has its own numbers."""
        return self._r("pr", seg(slug), number.cast("string"), F.lit(kind), cid.cast("string"))

    def project(self, name: Column) -> Column:
        return self._r("project", seg(name))

    def person(self, login: Column) -> Column:
        return self._r("person", seg(login))

    def learning(self, slug: Column, store: Column, lid: Column) -> Column:
        return self._r("learning", seg(slug), seg(store), seg(lid))

    def decision(self, slug: Column, kind: str, name: Column) -> Column:
        return self._r("decision", seg(slug), F.lit(kind), name)

    def topic(self, tag: Column) -> Column:
        return self._r("topic", seg(tag))

    def doc_site(self, root: Column) -> Column:
        return self._r("docsite", seg(root))

    def doc_page(self, url: Column) -> Column:
        return self._r("docpage", seg(url))

    def doc_section(self, url: Column, anchor: Column) -> Column:
        """Null for an empty anchor: text before the first heading has no node."""
        return F.when(anchor != "", F.concat(self.doc_page(url), F.lit("#"), anchor))

    def mcp_source(self, server: Column) -> Column:
        return self._r("mcpsource", seg(server))

    def mcp_page(self, server: Column, uri: Column) -> Column:
        return self._r("mcppage", seg(server), seg(uri))

    def mcp_section(self, server: Column, uri: Column, anchor: Column) -> Column:
        return F.when(anchor != "", F.concat(self.mcp_page(server, uri), F.lit("#"), anchor))


def run_id(pipeline_ver: Column, fingerprint: Column) -> Column:
    return F.substring(F.sha2(F.concat(pipeline_ver, F.lit("\n"), fingerprint), 256), 1, 16)


def run_id_of(pipeline_ver: str, fingerprint: str) -> str:
    return hashlib.sha256(f"{pipeline_ver}\n{fingerprint}".encode()).hexdigest()[:16]


def page_hash(text: Column, prefix: str = "") -> Column:
    """Hex SHA-256; crawled pages have it bare, resources with the prefix `sha256:`."""
    return F.concat(F.lit(prefix), F.sha2(text, 256))


def local_name(iri: Column) -> Column:
    """What follows the last #, and then the last /."""
    return F.substring_index(F.substring_index(iri, "#", -1), "/", -1)


def part_of(cfg: GraphConfig, s: Column) -> Column:
    """The snapshot part of a subject: its kind below resource/, `onto` for the vocabulary, else `other`."""
    rest = F.substr(s, F.lit(len(cfg.resource) + 1))
    kind = F.substring_index(rest, "/", 1)
    return F.when(s.startswith(cfg.resource), F.when(kind == "", F.lit("other")).otherwise(kind)).when(s.startswith(cfg.onto) | (F.instr(s, "#") > 0), F.lit("onto")).otherwise(F.lit("other"))
