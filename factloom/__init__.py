"""factloom: analytics over source-code facts, expressed as Spark DataFrame plans."""


def __getattr__(name: str):
    """``open_repo(spark, path)`` from the package itself, without importing Spark code before it is asked for."""
    if name == "open_repo":
        from .sources.code import open_repo

        return open_repo
    raise AttributeError(name)
