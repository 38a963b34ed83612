"""Schemas of the tables and documents the operators work on."""

from __future__ import annotations

SYSMETA = """
    identifier string, format_id string, size bigint, checksum struct<algorithm:string,value:string>,
    submitter string, rights_holder string,
    access array<struct<subjects:array<string>,permissions:array<string>>>,
    obsoletes string, obsoleted_by string, series_id string, archived boolean,
    date_uploaded timestamp, date_sysmetadata_modified timestamp,
    origin_member_node string, authoritative_member_node string, file_name string
"""

RUNS = """
    metadata_id string, suite_id string, ts timestamp, status string, error string,
    sequence_id string, is_latest boolean, run_count int
"""

NODES = """
    identifier string, name string, type string, state string, synchronize boolean,
    last_harvest string, base_url string
"""

NODE_HARVEST = "task_name string, task_type string, node_id string, last_harvest_datetime timestamp"

FILES = """
    file_id string, pid string, suite_id string, node_id string, format_filter string,
    creation_datetime timestamp, storage_type string, media_type string, alt_filename string
"""

# Score CSV: column names and order are fixed.
SCORE_CSV = """
    pid string, formatId string, dateUploaded timestamp, datasource string, scoreOverall double,
    scoreFindable double, scoreAccessible double, scoreInteroperable double, scoreReusable double,
    obsoletes string, obsoletedBy string, sequenceId string
"""

# Element names as the definition files write them.
_EXPRESSION = "expression:array<struct<_VALUE:string,_syntax:string>>"
_NAMESPACES = "namespaces:struct<namespace:array<struct<_VALUE:string,_prefix:string>>>"
_SUB = f"subSelector:struct<name:string,xpath:array<string>,{_EXPRESSION}>"
_SELECTOR = (
    f"struct<_namespaceAware:boolean,name:string,xpath:array<string>,{_SUB},{_NAMESPACES},{_EXPRESSION}>"
)
_DIALECT = f"struct<name:string,xpath:string,{_EXPRESSION}>"
_CHECK_FIELDS = (
    "id:string,name:string,description:string,type:string,level:string,environment:string,code:string,"
    f"library:array<string>,inheritState:boolean,selector:array<{_SELECTOR}>,dialect:array<{_DIALECT}>"
)
CHECK_XML = f"struct<{_CHECK_FIELDS},_corrupt:string>"
SUITE_XML = f"struct<id:string,name:string,description:string,{_NAMESPACES},check:array<struct<{_CHECK_FIELDS}>>,_corrupt:string>"

SYSMETA_XML = """struct<
    identifier:string, formatId:string, size:bigint, checksum:struct<_VALUE:string,_algorithm:string>,
    submitter:string, rightsHolder:string,
    accessPolicy:struct<allow:array<struct<subject:array<string>,permission:array<string>>>>,
    obsoletes:string, obsoletedBy:string, seriesId:string, archived:boolean,
    dateUploaded:timestamp, dateSysMetadataModified:timestamp,
    originMemberNode:string, authoritativeMemberNode:string, fileName:string, _corrupt:string>"""
