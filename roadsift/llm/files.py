"""Files in the folder that driver and executors share, by path or URL."""

from typing import BinaryIO

from pyarrow import fs


class Store:
    """The few file operations that archives and commits need, on whatever file system the folder is."""

    def __init__(self, system: fs.FileSystem):
        self.system = system

    def exists(self, path: str) -> bool:
        return self.system.get_file_info(path).type != fs.FileType.NotFound

    def create_dir(self, path: str) -> None:
        self.system.create_dir(path, recursive=True)

    def delete_dir(self, path: str) -> None:
        if self.exists(path):
            self.system.delete_dir(path)

    def children(self, path: str) -> list[str]:
        """The files in a folder, in order of name; none if it is not there."""
        found = self.system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(info.path for info in found if info.type == fs.FileType.File)

    def reader(self, path: str) -> BinaryIO:
        return self.system.open_input_stream(path, compression=None)

    def writer(self, path: str) -> BinaryIO:
        return self.system.open_output_stream(path, compression=None)


def opened(folder: str) -> tuple[Store, str]:
    """The store of a folder, and the folder's path there."""
    if "://" in folder:
        system, path = fs.FileSystem.from_uri(folder)
    else:
        system, path = fs.LocalFileSystem(), folder.removeprefix("file:")
    return Store(system), path


def moved(store: Store, temporary: str, final: str) -> None:
    """Renames a file; nothing happens if an earlier attempt did so."""
    if store.exists(temporary):
        store.system.move(temporary, final)
    elif not store.exists(final):
        raise FileNotFoundError(temporary)
