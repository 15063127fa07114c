"""Trip-profitability analytics as plain Spark DataFrame operators.

``functions``  Column -> Column rules (bands, labels, flags, unit conversions)
``operators``  DataFrame -> DataFrame steps (clean, join, profile, quality, model)
``sources``    readers and writers for the trip lake and its dimensions
``plans``      jobs that compose the above (month mart, backfill, feature builds)
"""
