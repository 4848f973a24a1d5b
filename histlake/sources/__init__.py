"""Table readers and the shared working folder."""

from histlake.sources.tables import TABLES, read_table, register_tables
from histlake.sources.workdir import remove, work_path, write, write_and_read

__all__ = ["TABLES", "read_table", "register_tables", "remove", "work_path", "write", "write_and_read"]
