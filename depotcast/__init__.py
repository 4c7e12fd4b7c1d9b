"""Multi-branch stock planning and demand forecasting on PySpark."""
