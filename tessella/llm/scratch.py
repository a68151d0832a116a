"""Cut tables of the training-data operators."""

from tessella.staging import Scratch, shared_folder

__all__ = ["Scratch", "shared_folder"]
