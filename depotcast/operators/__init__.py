"""Planning and forecasting operators: DataFrame in, DataFrame out."""
