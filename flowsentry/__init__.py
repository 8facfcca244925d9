"""Network and host intrusion analytics as DataFrame -> DataFrame functions."""
