"""The stages of the analysis over one folder of given tables."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import rename_snake
from ..operators.joins import attach_store
from ..operators.rows import holdout_start, open_with_sales, split_by_date
from ..plans import models
from ..plans.prepare import add_features, calendar_features, clean, fit_parameters, model_rows, prepare, training_rows
from ..schemas import JOINED_COLUMNS, SALES
from ..session import written
from ..sources import panel
from ..sources.parameters import Parameters


class Frames:
    """Each property is one stage; all are lazy but the dates, the distance fill and
    the parameters, each a value of one or a few rows."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def line(self) -> DataFrame:
        return panel.lines(self.spark, self.sf_dir)

    @cached_property
    def sales(self) -> DataFrame:
        return panel.sales_panel(self.line)

    @cached_property
    def store(self) -> DataFrame:
        return panel.store_panel(panel.suppliers(self.spark, self.sf_dir))

    @cached_property
    def future(self) -> DataFrame:
        return panel.future_panel(self.sales, self.cutoff)

    @cached_property
    def joined(self) -> DataFrame:
        return attach_store(self.sales, self.store)

    @cached_property
    def raw(self) -> DataFrame:
        return self.joined.toDF(*JOINED_COLUMNS)

    @cached_property
    def distance_fill(self) -> DataFrame:
        """One row: 10 x the largest distance of a store that has sales."""
        rivals = panel.selling_stores(self.line, self.store)
        return rivals.agg((F.max("CompetitionDistance") * 10).alias("value"))

    @cached_property
    def clean(self) -> DataFrame:
        return clean(self.raw, self.distance_fill.first()[0])

    @cached_property
    def features(self) -> DataFrame:
        return add_features(self.clean)

    @cached_property
    def training(self) -> DataFrame:
        return training_rows(self.features)

    @cached_property
    def named_sales(self) -> DataFrame:
        """The sales table with engine names, without a store joined to it."""
        return rename_snake(self.sales)

    @cached_property
    def sales_days(self) -> DataFrame:
        """Open days with sales and their calendar parts, for questions about no store column."""
        return open_with_sales(calendar_features(rename_snake(panel.sales_panel(self.line, spread=True))))

    @cached_property
    def open_days(self) -> DataFrame:
        """The training rows without the competition distance, hence without its fill job."""
        return training_rows(self.dated)

    @cached_property
    def dated(self) -> DataFrame:
        """All rows with features, without the competition distance."""
        return add_features(clean(self.raw, None).drop("competition_distance"))

    @cached_property
    def last(self) -> dt.date:
        return panel.panel_last_date(self.line)

    @property
    def cutoff(self) -> dt.date:
        return holdout_start(self.last)

    @cached_property
    def stored_training(self) -> DataFrame:
        """``training`` over sales rows that are grouped once and written: fits read them several times.

        The count of customers, which training rows do not have, is not taken.
        """
        sales = written(self.sales.drop("Customers"), "sales")
        counted = sales.withColumn("Customers", F.lit(None).cast("long")).select(*SALES.names)
        raw = attach_store(counted, self.store).toDF(*JOINED_COLUMNS)
        return training_rows(add_features(clean(raw, self.distance_fill.first()[0])))

    @cached_property
    def parameter_table(self) -> DataFrame:
        return fit_parameters(self.stored_training, self.distance_fill)

    @cached_property
    def parameters(self) -> Parameters:
        return Parameters.from_table(self.parameter_table)

    @cached_property
    def prepared(self) -> DataFrame:
        return model_rows(prepare(self.stored_training, self.parameters))

    @property
    def feature_rows(self) -> DataFrame:
        return models.feature_rows(self.prepared)

    @property
    def log_sales(self) -> DataFrame:
        """Store, date and log sales of the training rows: no parameters needed."""
        return self.sales_days.select("store", "date", F.log1p("sales").alias("sales"))

    def scored_by_average(self, fit_on: str = "train") -> DataFrame:
        train, test = split_by_date(self.log_sales, self.cutoff)
        return models.average_model(train, test, fit_on)
