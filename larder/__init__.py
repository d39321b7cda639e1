"""Daily demand, menu, cart and order analytics as Spark DataFrame functions.

Every operator takes DataFrames and parameters and returns a DataFrame; nothing is collected, and only
``larder.sources.sinks`` writes.
"""
