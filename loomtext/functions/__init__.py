from . import text  # noqa: F401
