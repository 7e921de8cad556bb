"""Tables written to the shared scratch folder: those of the library."""

from ..sources.scratch import shared_folder, written

__all__ = ["shared_folder", "written"]
