from .tables import TABLES, read_table, read_text_lines, write_text  # noqa: F401
