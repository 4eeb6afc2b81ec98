"""The committed functions are those of the sources."""

import glob
import os
import shutil
import subprocess
import zipfile

import pyspark
import pytest

HERE = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.skipif(not shutil.which("javac"), reason="no compiler here")
def test_jar_is_built_from_sources(tmp_path):
    folder = f"{HERE}/scoria/llm/jvm"
    jars = os.path.join(os.path.dirname(pyspark.__file__), "jars", "*")
    subprocess.run(["javac", "-nowarn", "--release", "17", "-cp", jars, "-d", str(tmp_path), *sorted(glob.glob(f"{folder}/src/scoria/llm/*.java"))], check=True, capture_output=True)
    built = {os.path.relpath(p, tmp_path): open(p, "rb").read() for p in glob.glob(f"{tmp_path}/**/*.class", recursive=True)}
    with zipfile.ZipFile(f"{folder}/texts.jar") as jar:
        assert {n: jar.read(n) for n in jar.namelist() if n.endswith(".class")} == built
