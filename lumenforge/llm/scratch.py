"""The shared folder's tables, under the name that the operators use."""

from lumenforge.scratch import clear, folder, made, table

__all__ = ["clear", "folder", "made", "table"]
