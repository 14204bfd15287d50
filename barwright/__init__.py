"""Daily market data on Spark: curate, adjust, measure, label.

Every operator is a plain ``DataFrame -> DataFrame`` function or a ``Column`` builder;
``barwright.plans`` joins them into the batch jobs.
"""
