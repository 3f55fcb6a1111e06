"""Declared schemas of the inputs, so that readers never infer types from data."""

from __future__ import annotations

TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}

SBOM = (
    "metadata struct<component: struct<`bom-ref`: string>>, "
    "components array<struct<`bom-ref`: string, name: string, version: string, purl: string, `group`: string, licenses: array<struct<license: struct<id: string, name: string>>>>>, "
    "dependencies array<struct<ref: string, dependsOn: array<string>>>"
)
OSV = (
    "id string, summary string, published string, modified string, withdrawn string, aliases array<string>, severity array<struct<type: string, score: string>>, "
    "affected array<struct<package: struct<name: string, ecosystem: string, purl: string>, ranges: array<struct<type: string, events: array<struct<introduced: string, fixed: string>>>>, versions: array<string>>>, "
    "database_specific struct<severity: string>"
)
VDR = (
    "vulnerabilities array<struct<id: string, vuln_id: string, description: string, detail: string, summary: string, severity: string, component: string, version: string, fixed_version: string, epss: double, "
    "ratings: array<struct<severity: string, score: double>>, affects: array<struct<ref: string, versions: array<struct<version: string, status: string>>>>, "
    "properties: array<struct<name: string, value: string>>, published: string, aliases: array<string>>>"
)
FLOW_SLICES = (
    "flows array<struct<parentFileName: string, parentMethodName: string, lineNumber: bigint, tags: string, fullName: string, name: string, isExternal: boolean>>, purls array<string>"
)
USAGE_SLICES = (
    "objectSlices array<struct<fileName: string, fullName: string, lineNumber: bigint, usages: array<struct<targetObj: struct<name: string, typeFullName: string, lineNumber: bigint, label: string>, invokedCalls: array<struct<resolvedMethod: string>>>>>>, "
    "userDefinedTypes array<struct<name: string, fileName: string, procedures: array<struct<callName: string, lineNumber: bigint>>>>"
)
SECRETS = (
    "DetectorName string, Raw string, Verified boolean, SourceMetadata struct<Data: struct<Filesystem: struct<file: string, line: bigint>, Git: struct<file: string, line: bigint>>>"
)
KEV = "vulnerabilities array<struct<cveID: string>>"
