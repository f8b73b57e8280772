"""Tables that a job writes in the folder which driver and executors share."""

from voxloom.sources.stored import new_path, removed, saved, shared_dir

__all__ = ["new_path", "removed", "saved", "shared_dir"]
