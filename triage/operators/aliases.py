"""Logical-column resolution by header alias lists (analysis-time only).

A detector asks for logical columns (pid, name, dst_port, ...); each is found
by trying its candidate header names in priority order against the table's
headers, lower-cased and stripped.  Absent columns become ''.  The result is
a DataFrame with one cleaned string column per logical name plus _row_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triage.functions.cells import clean, col_or_empty
from triage.functions.memo import per_context
from triage.table import ForensicTable

# ----------------------------------------------------------------------------
# FIXED VALUES: candidate header names per logical column, in priority order
# ----------------------------------------------------------------------------
PID = ["pid", "process_id"]
PROC_NAME = ["name", "process_name", "image", "image_name", "imagename"]
PPID = ["ppid", "parent_pid", "parent_process_id", "inheritedfrompid"]
PARENT_NAME = ["parent_name", "parent_process", "parent_image", "parent"]

NET = {
    "pid": PID,
    "src_addr": ["src-addr", "src_addr", "local-addr", "local_addr", "localaddr", "srcaddr"],
    "src_port": ["src-port", "src_port", "local-port", "local_port", "localport", "srcport"],
    "dst_addr": ["dst-addr", "dst_addr", "remote-addr", "remote_addr", "remoteaddr", "dstaddr",
                 "foreign-addr", "foreign_addr"],
    "dst_port": ["dst-port", "dst_port", "remote-port", "remote_port", "remoteport", "dstport",
                 "foreign-port", "foreign_port"],
    "protocol": ["protocol", "proto", "type"],
    "state": ["state", "st", "status"],
}

PROCESS_LOOKUP = {"pid": PID, "name": PROC_NAME}

DNS = {
    "pid": PID,
    "name": ["name", "process_name", "process", "image", "image_name"],
    "query": ["query", "domain", "dns_query", "hostname", "host", "record", "query_name"],
}

PROCESS_MASQUERADE = {
    "pid": PID,
    "name": PROC_NAME,
    "path": ["path", "image_path", "filepath", "file_path", "full_path", "process_path"],
    "ppid": PPID,
    "parent_name": PARENT_NAME,
    "user": ["user", "username", "user_name", "sid", "owner", "account", "user_sid"],
    "cmdline": ["cmdline", "commandline", "command_line", "cmd"],
}

PROCESS_LATERAL = {
    "pid": PID,
    "name": PROC_NAME,
    "ppid": PPID,
    "parent_name": PARENT_NAME,
    "cmdline": ["cmdline", "commandline", "command_line", "cmd", "command"],
}

PROCESS_INJECTION = {
    "pid": PID,
    "name": PROC_NAME,
    "path": ["path", "image_path", "filepath", "file_path", "full_path"],
}

MEMORY = {
    "pid": PID,
    "name": ["name", "process_name", "process", "image", "image_name"],
    "address": ["address", "addr", "va", "va-start", "start", "start_address", "base", "base_address"],
    "size": ["size", "region_size", "region-size", "length", "cb"],
    "protection": ["protection", "prot", "protect", "flags", "page_protection", "page-protection"],
    "file": ["file", "filename", "file_name", "filepath", "file_path", "path", "module", "backed_by",
             "description", "desc", "tag", "info"],
    "type": ["type", "region_type", "vadtype", "vad_type"],
}

REGISTRY = {
    "path": ["path", "key", "key_path", "registry_path", "reg_path", "hive_path", "keypath"],
    "name": ["name", "value_name", "valuename", "entry", "value"],
    "data": ["data", "value_data", "valuedata", "content", "value_content"],
    "type": ["type", "value_type", "reg_type", "datatype"],
}

SERVICES = {
    "name": ["name", "service_name", "servicename", "display_name"],
    "binary_path": ["binary_path", "binarypath", "image_path", "imagepath", "path", "binary",
                    "pathname", "command", "cmdline"],
    "start_type": ["start_type", "starttype", "start", "startup"],
    "state": ["state", "status", "current_state"],
}

TASKS = {
    "name": ["name", "task_name", "taskname"],
    "action": ["action", "actions", "command", "cmdline", "exec", "task_action", "execute", "program"],
    "trigger": ["trigger", "triggers", "schedule", "next_run"],
    "status": ["status", "state", "enabled"],
}

# file table (entropy enrichment): duplicates resolve to the LAST occurrence
FILE_PATH = ["file", "filepath", "file_path", "path", "name", "filename", "file_name", "File", "FilePath",
             "Path", "Name"]
FILE_ID = ["file_id", "fileid", "id", "File_ID", "FileID", "ID"]


def find_header(headers: list[str], candidates: list[str], dup: str = "first") -> int | None:
    """Index of the best-ranked candidate among the headers (case/space-insensitive).

    With duplicate headers, ``dup='first'`` picks the first occurrence,
    ``dup='last'`` the last one.
    """
    keyed = [h.strip().lower() for h in headers]
    for cand in candidates:
        want = cand.lower()
        hits = [i for i, k in enumerate(keyed) if k == want]
        if hits:
            return hits[0] if dup == "first" else hits[-1]
    return None


def resolve_indices(t: ForensicTable, spec: dict[str, list[str]], dup: str = "first") -> dict[str, int | None]:
    return {k: find_header(t.headers, v, dup) for k, v in spec.items()}


@per_context
def _logical_columns(phys: tuple) -> list:
    return [clean(col_or_empty(c)).alias(k) for k, c in phys]


def resolve(t: ForensicTable, spec: dict[str, list[str]], keep: tuple[str, ...] = ("_row_id",),
            dup: str = "first") -> tuple[DataFrame, dict[str, bool]]:
    """Project ``t`` onto logical columns.  Returns (df, present-flags)."""
    idx = resolve_indices(t, spec, dup)
    cols = _logical_columns(tuple((k, t.column_for(i)) for k, i in idx.items()))
    extra = [F.col(c) for c in keep if c in t.df.columns]
    present = {k: i is not None for k, i in idx.items()}
    return t.df.select(*extra, *cols), present
