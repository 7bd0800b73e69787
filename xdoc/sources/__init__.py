"""Line-delimited documents: batch, streaming, quarantine."""
