"""Line formats as streams."""
