"""Tables in the folder that all executors share, to cut lineage."""

from batchloom.plans.settle import cut, delete, folder, scratch

__all__ = ["cut", "delete", "folder", "scratch"]
