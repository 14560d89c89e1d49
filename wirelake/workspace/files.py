"""Small files of a workspace, on whatever file system its path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Text files and folders under ``root`` through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.root = root.rstrip("/")
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = at.getFileSystem(self.conf)

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def make(self) -> None:
        self.fs.mkdirs(self.path())

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path())) if self.exists() else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file is new and was written; an existing one stays as it is."""
        try:
            stream = self.fs.create(self.path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        """At every moment readers find the old or the new text."""
        self.delete(f".{name}.new")
        self.create(f".{name}.new", text)
        self.put_over(f".{name}.new", name)

    def put_over(self, old: str, new: str) -> None:
        """Rename a file over another: at every moment there is the one or the other."""
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        gateway = self.jvm
        options = gateway_array(gateway, option.OVERWRITE)
        context.rename(self.path(old), self.path(new), options)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.path(old), self.path(new)):
            raise OSError(f"{old} can't become {new}")

    def is_folder(self, name: str) -> bool:
        return self.exists(name) and self.fs.getFileStatus(self.path(name)).isDirectory()

    def changed(self, name: str) -> float:
        """When a file was last written, in seconds since 1970."""
        return self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def same(self, other: str) -> bool:
        """Whether ``other`` is this root or lies in it."""
        full = lambda p: self.fs.makeQualified(p).toString().rstrip("/")
        mine, theirs = full(self.path()), full(self.jvm.org.apache.hadoop.fs.Path(other))
        return theirs == mine or theirs.startswith(mine + "/")


def gateway_array(jvm, *items):
    from pyspark import SparkContext

    out = SparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, len(items))
    for i, x in enumerate(items):
        out[i] = x
    return out
