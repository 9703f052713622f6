"""fathom: labelled depth-image time series and table analytics on Spark."""
