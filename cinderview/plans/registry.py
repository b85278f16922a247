"""Where queries and the SQL they are checked with are registered together."""

from . import fixtures

QUERIES = {}
CHECKS = {}


class Views:
    """Attribute access to tables and telemetry views of one data folder."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name):
        if name in fixtures.VIEWS:
            df = fixtures.view(self.spark, self.sf_dir, name)
        elif name in fixtures.TABLES:
            df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        else:
            raise AttributeError(name)
        # Resolved once per query, however many parts of it read the view.
        self.__dict__[name] = df
        return df

    def sql(self, text):
        return self.spark.sql(fixtures.with_views(text, lambda t: fixtures.spark_tables(t, self.sf_dir)))


def query(name, check=None):
    """Register ``fn(views) -> DataFrame`` and, where SQL can say it, its check."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if check is not None:
            CHECKS[name] = fixtures.with_views(check, fixtures.check_tables)
        return fn

    return add
